"""SimHash fingerprints and near-duplicate components, candidates pruned by the pigeonring principle.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word shingles. Two fingerprints
link at ``distance`` or fewer differing bits. Cut the bits into a ring of ``SEGMENTS`` segments: if all differences sum
to t, then from some segment on, every run of consecutive segments has at most its share of t, length * t / SEGMENTS.
For 3 bits and 4 segments the runs from there have at most 0, 1, 2 and 3 differences. So a pair shares one whole
segment, and the next one but for one bit: an equality join on 32 bits, one side with the 17 ways to spell the next
segment. The rest of the chain is checked on what joins, then the full distance.

Equal fingerprints collapse to one row first, so copies never meet in the join. Components come from rounds of
star contraction, each a table in the shared folder; nothing but counts reaches the driver.

A null or empty text has fingerprint zero, linked like any other; fewer words than a shingle: the whole sequence.
Repeated rows and equal ids are rows of their own; a null id never names a component unless all are null. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm import text
from shoebox.llm.spark import lookup
from shoebox.session import durable

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
SEED = 42


def _fingerprints(part: text.Slice, shingle: int) -> np.ndarray:
    raw = text.LOWER[part.raw]
    start, end, doc = text.words(raw, part.bounds)
    docs = part.last - part.first
    out = np.zeros(docs, np.uint64)
    if not len(start):
        return out
    # Words with one space between them, as in the shingles.
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.repeat(place, size) + text.spread(size)] = raw[np.repeat(start, size) + text.spread(size)]
    view = memoryview(joined.tobytes())
    n_words = np.bincount(doc, minlength=docs)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first_word = np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(docs), n)
    head = first_word[owner] + text.spread(n)
    tail = np.minimum(head + shingle, first_word[owner] + n_words[owner]) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(place[head].tolist(), (place[tail] + size[tail]).tolist(), strict=True)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(head))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    has = np.flatnonzero(n)
    ones = np.add.reduceat(bits, (np.cumsum(n) - n)[has], axis=0, dtype=np.int32)
    major = np.packbits(ones * 2 > n[has][:, None], axis=1, bitorder="little")
    out[has] = np.ascontiguousarray(major).view("<u8").ravel()
    return out


def fingerprints(rows: DataFrame, shingle: int, keep_text: bool = False) -> DataFrame:
    """The rows with the fingerprint of ``text`` as a signed long in ``fp``; the text goes unless it is to be kept."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprints(part, shingle) for part in text.slices(batch)]
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            kept = [k for k, c in enumerate(batch.schema.names) if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(values.view(np.int64))],
                names=[*(batch.schema.names[k] for k in kept), "fp"],
            )

    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    return rows.mapInArrow(text.returned(task), T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _segment(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _key(k: int, exact: Column, near: Column) -> Column:
    """Segment number, the segment that is equal, and the next one, in one long."""
    return F.lit(k).cast("long") * F.lit(1 << 2 * WIDTH) + exact * F.lit(1 << WIDTH) + near


def links(values: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most ``distance`` bits; 0 <= distance <= 3."""
    budget = [(run + 1) * distance // SEGMENTS for run in range(SEGMENTS)]
    if budget[0] or budget[1] > 1:
        raise ValueError("the join covers distances up to 3")
    fp = F.col("fp")
    held = values.select(fp.alias("b"), F.explode(F.array(*(_key(k, _segment(fp, k), _segment(fp, k + 1)) for k in range(SEGMENTS)))).alias("key"))
    flips = [0, *(1 << bit for bit in range(WIDTH))] if budget[1] else [0]
    probes = values.select(
        fp.alias("a"),
        F.explode(
            F.array(*(_key(k, _segment(fp, k), _segment(fp, k + 1).bitwiseXOR(F.lit(x).cast("long"))) for k in range(SEGMENTS) for x in flips))
        ).alias("key"),
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.shiftrightunsigned("key", 2 * WIDTH)
    # The ring turned so that the chain's first segment is lowest.
    turned = F.when(first == 0, differ)
    for k in range(1, SEGMENTS):
        low = F.shiftrightunsigned(differ, WIDTH * k)
        turned = turned.when(first == k, low.bitwiseOR(F.shiftleft(differ, 64 - WIDTH * k)))
    chain = [F.bit_count(turned.bitwiseAND(F.lit((1 << WIDTH * (run + 1)) - 1))) <= budget[run] for run in range(SEGMENTS - 1)]
    viable = held.join(probes, "key").where(F.col("a") < F.col("b"))
    for step in chain:
        viable = viable.where(step)
    return viable.where(F.bit_count(differ) <= distance).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the pairs: large-star and small-star rounds until every node hangs on its root."""
    edges, before = durable(pairs), None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = durable(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("n"))
        edges = durable(small.where(F.col("m") != F.col("n")).select(F.col("m").alias("a"), F.col("n").alias("b")).distinct())
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def classes(rows: DataFrame, shingle: int, distance: int) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row with doc_id and text."""
    marked = durable(fingerprints(rows.select(F.col("doc_id").cast("long"), "text"), shingle))
    return grouped(marked, distance).select("doc_id", "fp", "component_id")


def grouped(marked: DataFrame, distance: int) -> DataFrame:
    """The rows of a durable table with doc_id and fp, with component_id and ``root``, a fingerprint that the component has for its own."""
    values = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(values.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = durable(values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # Only fingerprints with a link need their component's least id.
    linked = rooted.join(roots.select(F.col("root")).distinct(), "root", "left_semi")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(named, "root", "left").select("fp", "rows", "root", F.coalesce("component_id", "least").alias("component_id")))
    return lookup(marked, named, "fp", "rows").select(*marked.columns, "component_id", "root")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
