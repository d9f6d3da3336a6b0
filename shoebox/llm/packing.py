"""Best-fit-decreasing packing of token runs, certified by dual-feasible-function bounds and mended by exchange.

``pieces`` tokenizes each whole document once and cuts only those longer than a sequence; what leaves is one short
row per piece. ``pack`` deals the pieces over bounded partitions by a hash of their row, so no key gathers rows, packs each partition by best fit
decreasing, and holds the number of sequences against a lower bound that no packing of these lengths can beat.
A partition that meets its bound is final. Partitions with a gap, and the one slack sequence of the others, put the
documents of their unfilled sequences into a pool; the pool is dealt anew and packed again, as long as that saves sequences.
Each round is a table in the shared folder, so a lost executor costs that round's tasks.

Nulls: a null text is empty, and a piece of one end token; null ids keep their rows; repeated rows are packed each.
No documents: no rows. Ties go to the lower bin. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import text, tokens
from shoebox.session import durable

PART = 32_768  # pieces of a partition, about
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
PACKED = PIECES + ", sequence_id long, offset long, slack int, gap int, part long"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the bounds: all lengths together; small lengths dropped and large ones rounded up; Fekete and Schepers' u_k."""
    count = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # With threshold e: above capacity - e counts as a whole sequence, below e as nothing.
    total, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    e = np.arange(1, capacity // 2 + 1)
    large = total[-1] - total[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        # u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of capacity * k * (k + 1)
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k * (k + 1), (k + 1) * size // capacity * capacity * (k + 1))
        best = max(best, -(-int((count * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size by best fit decreasing, and each bin's slack."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    slack: list[int] = []
    open_bins: dict[int, list[int]] = {}
    present = 0  # bit r: some bin has slack r
    for k in order.tolist():
        size = int(sizes[k])
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = open_bins[room]
            b = held.pop()
            if not held:
                present &= ~(1 << room)
        else:
            b, room = len(slack), capacity
            slack.append(capacity)
        bins[k], offsets[k] = b, capacity - room
        left = room - size
        slack[b] = left
        if left:
            open_bins.setdefault(left, []).append(b)
            present |= 1 << left
    return bins, offsets, np.array(slack, np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document; only documents longer than ``capacity`` are cut, the first piece being the shorter one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                ids, bounds = tokens.with_end(*tokens.encode(part.raw, part.bounds, tokenizer), end_id)
                n = np.diff(bounds)
                many = -(-n // capacity)
                number = text.spread(many)
                doc = np.repeat(np.arange(len(n)), many)
                first = n[doc] - (many[doc] - 1) * capacity
                start = np.where(number == 0, 0, first + (number - 1) * capacity)
                length = np.where(number == 0, first, capacity)
                at = bounds[doc] + start
                crc = [tokens.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(part.first + doc)),
                        pa.array(number, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    cut = rows.mapInArrow(text.returned(task), PIECES.rsplit(",", 1)[0])
    return durable(cut.withColumn("row", F.monotonically_increasing_id()))


def _pack(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Deal the rows over ``parts`` partitions and pack each."""

    def task(rows):
        rows = rows.sort_values("row", kind="stable")
        bins, offsets, slack = best_fit(rows["length"].to_numpy(), capacity)
        gap = len(slack) - lower_bound(rows["length"].to_numpy(), capacity)
        part = rows["part"].to_numpy()
        return rows.assign(sequence_id=(turn << 58) | (part << 30) | bins, offset=offsets, slack=slack[bins].astype(np.int32), gap=np.int32(gap))

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
    return durable(dealt.groupBy("part").applyInPandas(task, PACKED))


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """A sequence and an offset in it for every piece."""

    def parts(n: int) -> int:
        return max(1, -(-n // PART))

    n = cut.count()
    if not n:
        return cut.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("sequence_id", "long"), ("offset", "long")))).drop("row")
    packed = _pack(cut, parts(n), 0, capacity)
    for turn in range(1, ROUNDS + 1):
        # With a gap every unfilled sequence is given up; without one, those filled to less than half.
        pooled = (F.col("slack") > 0) & ((F.col("gap") > 0) | (F.col("slack") * 2 > capacity))
        pool = packed.where(pooled)
        found = pool.agg(
            F.count("*").alias("rows"), F.sum((F.col("offset") == 0).cast("long")).alias("bins"), F.sum("length").alias("length")
        ).first()
        if not found["rows"] or found["bins"] <= -(-found["length"] // capacity):
            break
        again = _pack(pool.select(*PIECE_NAMES), parts(found["rows"]), turn, capacity)
        if again.where(F.col("offset") == 0).count() >= found["bins"]:
            break
        packed = durable(packed.where(~pooled).unionByName(again))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
