"""Stored index of 64-bit hashes: which contents are near a hash of a batch, without reading the library.

The index holds every hash once per mask of the Hamming join (``threshold + 1`` masks of one block each: two hashes within the
threshold agree on one of them). A copy lies in the partition folder ``of=<level>/mask=<mask>/bucket=<hash of the masked bits mod
level>``. A batch appends a set of folders of its own, of a level that fits its size, so what a commit writes follows the batch;
when sets pile up they are rebuilt as one.

A lookup keys its probes the same way, once per level. Few probes are broadcast, after counting them, and prune the
folders to be read while the query runs; many probes meet one copy of the index in the keyed join instead. Both return whole contents: every
one within the threshold of any probe. The matching rules need no other stored content, so they run on that short table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.bits import hamming
from shoebox.operators.hamming_join import candidates, masks

THRESHOLD = settings.NEAR_THRESHOLD  # what the stored copies are keyed for
FAMILY = masks(THRESHOLD, THRESHOLD + 1)
LEVELS = (1, 16, 256, 4096)  # folders per mask
ROWS_PER_FOLDER = 50_000
FEW = 10_000  # distinct probes that are broadcast: FEW rows per mask and level of about 40 bytes
PARTITIONS = ("of", "mask", "bucket")


def level_for(rows: int) -> int:
    """Folders per mask for so many hashes."""
    return next((n for n in LEVELS if rows <= n * ROWS_PER_FOLDER), LEVELS[-1])


def _masked(bits: str, mask: str) -> Column:
    return F.col(bits).bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in FAMILY]), F.col(mask) + 1))


def _bucket(bits: str, mask: str, level: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(mask), _masked(bits, mask)), level).cast("int")


def keyed(hashes: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """A copy of each row (``bits`` and more) per mask and level, with the folder it belongs to."""
    rows = hashes.select("*", F.explode(F.array(*[F.lit(n) for n in levels])).alias("of"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FAMILY) - 1))).alias("mask"))
    return rows.withColumn("bucket", _bucket("bits", "mask", F.col("of")))


def index_rows(hashes: DataFrame) -> DataFrame:
    """Rows of the index for ``id``, ``bits``: one set of folders, to be appended or to replace all. Null hashes have no place."""
    known = hashes.where(F.col("bits").isNotNull()).select("id", "bits")
    return keyed(known, (level_for(known.count()),))


def all_hashes(index: DataFrame) -> DataFrame:
    """``id``, ``bits`` of everything in the index, from one copy."""
    return index.where(F.col("mask") == 0).select("id", "bits").distinct()


def near(index: DataFrame, probes: DataFrame, threshold: int = THRESHOLD, few: int = FEW) -> DataFrame:
    """``id``, ``bits`` of the indexed contents within ``threshold`` of any probe's ``bits``.

    ``probes`` is a durable table: it is counted, then read. The stored copies answer any threshold up to the one they are keyed for; a
    larger one, like a batch of many probes, goes through the keyed join over one copy.
    """
    asked = probes.where(F.col("bits").isNotNull()).select(F.col("bits").alias("_bits")).distinct()
    if threshold > THRESHOLD or asked.limit(few + 1).count() > few:
        stored = all_hashes(index)
        hit = candidates(asked, stored.select(F.col("bits").alias("_ibits")).distinct(), "_bits", "_ibits", threshold)
        return stored.join(hit.select(F.col("_ibits").alias("bits")).distinct(), "bits", "left_semi").select("id", "bits")
    # The comparison makes the probes a selective side in Spark's eyes, so that their folders prune the scan.
    places = keyed(asked.withColumnRenamed("_bits", "bits"), LEVELS).where(F.col("mask") >= 0)
    places = F.broadcast(places.withColumnRenamed("bits", "_bits").withColumn("_part", _masked("_bits", "mask")))
    same = [*PARTITIONS]
    met = index.join(places, same).where((_masked("bits", "mask") == F.col("_part")) & (hamming("bits", "_bits") <= threshold))
    return met.select("id", "bits").distinct()
