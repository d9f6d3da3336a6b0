"""Hamming-distance join over 64-bit hashes by exact block keys.

Cut the 64 bits into ``b`` blocks. Two hashes within distance ``t`` differ in at most ``t`` blocks,
so they agree on all bits of at least one choice of ``b - t`` blocks. Each choice is a bit mask; a
hash is keyed once per mask by ``hash & mask`` and candidates meet by equality on (mask, key).
More blocks mean longer keys and more copies of each row, so ``b`` follows the table size.

Keys that hold many rows are not joined as they are. Each row with such a key is keyed anew, once,
by longer masks of interleaved bits: those masks cover the whole hash on their own, so every pair
within ``t`` among these rows is kept. What is still large is spread over a grid: one side's rows
are dealt over the grid's rows and copied to all its columns, the other side the other way round,
so every pair meets in one cell.

The result is aggregated per probe row in the join's own tasks: pairs are never written out.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.bits import hamming
from shoebox.session import durable

BITS = 64
ROWS_PER_TASK = 2_000_000


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def block_count(threshold: int, rows: int, per_key: int = 64) -> int:
    """Fewest blocks whose keys are long enough for about ``per_key`` rows each."""
    wanted = log2(max(2.0, rows / per_key))
    for blocks in range(threshold + 1, threshold + 5):
        if BITS * (blocks - threshold) / blocks >= wanted or comb(blocks + 1, threshold) > 130:
            return blocks
    return threshold + 4


def masks(threshold: int, blocks: int, interleaved: bool = False) -> list[int]:
    """Bit masks of every choice of ``blocks - threshold`` blocks, as signed 64-bit numbers."""
    members: list[int] = [0] * blocks
    for bit in range(BITS):
        block = bit % blocks if interleaved else bit * blocks // BITS
        members[block] |= 1 << bit
    return [
        _signed(sum(members[i] for i in choice))
        for choice in combinations(range(blocks), blocks - threshold)
    ]


def _keyed(rows: DataFrame, hash_col: str, family: list[int], level: int) -> DataFrame:
    """One copy of a row per mask. The key is a hash of (level, mask number, masked bits): equal
    parts give equal keys, so no pair is lost, and a collision only adds a candidate that the
    distance test removes."""
    keys = F.array(
        *[F.xxhash64(F.lit(level), F.lit(i), F.col(hash_col).bitwiseAND(F.lit(m))) for i, m in enumerate(family)]
    )
    return rows.select("*", F.explode(keys).alias("_key"))


def _large(sides: list[DataFrame], limit: int) -> DataFrame:
    """Keys that hold more than ``limit`` rows on some side, with that count."""
    keys = [
        side.groupBy("_key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit) for side in sides
    ]
    both = keys[0]
    for other in keys[1:]:
        both = both.unionByName(other).groupBy("_key").agg(F.max("_rows").alias("_rows"))
    return both


def _deal(rows: DataFrame, hash_col: str, probe: bool) -> DataFrame:
    """Place rows with a ``_grid`` side length on the grid; NULL means one cell."""
    side = F.coalesce("_grid", F.lit(1)).cast("long")
    spread = rows.withColumn("_mine", F.pmod(F.xxhash64(hash_col), side)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), side - 1))
    )
    row, column = ("_mine", "_other") if probe else ("_other", "_mine")
    return spread.withColumn("_key", F.xxhash64("_key", row, column)).drop("_mine", "_other", "_grid")


def _split_keys(probe, index, p_hash, i_hash, threshold, limit, subset):
    """Return both keyed sides changed so that no key holds much more than ``limit`` rows."""
    large = durable(_large([index] if subset else [index, probe], limit).select("_key"))
    if large.isEmpty():
        return probe, index
    plain = [side.join(large, "_key", "left_anti") for side in (probe, index)]
    crowded = [
        durable(side.join(large, "_key", "left_semi").drop("_key").distinct()) for side in (probe, index)
    ]
    size = max(side.count() for side in crowded)
    # Crowded rows share many bits, which tell nothing apart: take longer masks than for others.
    fine = masks(threshold, block_count(threshold, 64 * size), interleaved=True)
    refined = [_keyed(side, h, fine, 2) for side, h in zip(crowded, (p_hash, i_hash))]
    grids = durable(
        _large(refined[1:] if subset else refined, limit).select(
            "_key", F.ceil(F.col("_rows") / F.lit(limit)).alias("_grid")
        )
    )
    if not grids.isEmpty():
        refined = [
            _deal(side.join(grids, "_key", "left"), h, probe=i == 0)
            for i, (side, h) in enumerate(((refined[0], p_hash), (refined[1], i_hash)))
        ]
    return tuple(p.unionByName(r) for p, r in zip(plain, refined))


def candidates(
    probe: DataFrame,
    index: DataFrame,
    probe_hash: str,
    index_hash: str,
    threshold: int = settings.NEAR_THRESHOLD,
    rows: int | None = None,
    limit: int = settings.HOT_ROWS,
    blocks: int | None = None,
    subset: bool = False,
) -> DataFrame:
    """All (probe row, index row) within ``threshold``, with ``distance``; lazily, with repeats.

    A pair appears once per mask on which it agrees: aggregate with min or max. Column names of
    the two sides must differ. ``rows`` is the larger side's row count if known; ``subset`` tells
    that every probe hash is also in the index, whose key counts then speak for both.
    """
    if not 0 <= threshold < BITS:
        raise ValueError("threshold must be between 0 and 63")
    if rows is None:
        rows = index.count() if subset else max(probe.count(), index.count())
    blocks = blocks or block_count(threshold, rows)
    family = masks(threshold, min(blocks, BITS))
    left = _keyed(probe, probe_hash, family, 1)
    right = _keyed(index, index_hash, family, 1)
    if rows > limit:
        left, right = _split_keys(left, right, probe_hash, index_hash, threshold, limit, subset)
    # By the bytes of these narrow rows alone Spark would merge the join into a few tasks, but its
    # work is the pairs they form.
    spark = probe.sparkSession
    wanted = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        rows * len(family) // ROWS_PER_TASK,
    )
    left, right = left.repartition(wanted, "_key"), right.repartition(wanted, "_key")
    distance = hamming(probe_hash, index_hash)
    met = left.join(right, "_key").where(distance <= threshold)
    return met.withColumn("distance", distance).drop("_key")
