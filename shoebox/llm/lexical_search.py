"""Ranked lexical search over an inverted index of document blocks: term-at-a-time for short lists, document-at-a-time over long ones.

``index`` cuts the documents into blocks of about ``BLOCK`` bytes of text, each one row: its vocabulary, its postings by
term, and the ids and lengths of its documents. ``search`` weighs the terms of a block of items by their document
frequency in the whole index and answers every item in every index block:

1. Lists of at most 1/``SHORT`` of the block's documents are taken term at a time: their contributions are summed per document and
   kept in document order. From here on these accumulators act as one list, with the largest sum per range of documents as its bound.
2. Accumulators and long lists, each bounded by its largest contribution per range, are walked together in document order.
   A range whose bounds add up to less than the k-th best score so far is skipped and its postings are never read; the others are summed.

A task keeps k results per item through all its blocks, so its bar rises as it goes; one window per item ranks what the tasks
return. Bounds and scores are integers, so no rounding can skip a result.

Terms are told apart by 64-bit hashes, and a hit's bytes are compared with the item's. A null or empty text has no
term: it is not counted and never found. Repeated rows and equal ids are documents of their own; of equal scores the
lesser id comes first, null ids last. Rows of one item_id (null too) are one item with the terms of all their texts, once
each. Very long texts are a block of their own, whole. No documents or no items: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoebox.llm import text
from shoebox.llm.blobs import found_in, pack, unpack
from shoebox.session import durable

BLOCK = 12 << 20
ITEM_BYTES = 2 << 20  # of items' texts that one pass over the index answers
SHORT = 16
RANGE = 128
STEP = 8  # ranges summed at once, before the bar is looked at again
INDEX = "n_docs long, n_terms long, vocabulary binary, postings binary, rows binary"
FOLD = text.LOWER.copy()
FOLD[:0x80][[not chr(c).isalnum() for c in range(0x80)]] = 0x20
NULL_ID = np.iinfo(np.int64).max


def terms_of(value: str) -> list[bytes]:
    """The distinct terms of one text, in order of their bytes."""
    raw = FOLD[np.frombuffer(value.encode(), np.uint8)]
    return sorted(set(raw.tobytes().split()))


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    size = size.astype(np.int64)
    return raw[np.repeat(start, size) + text.spread(size)]


class _Block:
    """The documents of a block while it fills."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.ids: list[pa.Array] = []
        self.docs = self.size = 0

    def add(self, part: text.Slice, ids: pa.Array) -> None:
        raw = FOLD[part.raw]
        start, end, doc = text.words(raw, part.bounds)
        key = text.span_hash(text.prefix(raw), start, end)
        self.parts.append((raw, start + self.size, (end - start).astype(np.uint32), (doc + self.docs).astype(np.uint32), key))
        self.ids.append(ids)
        self.docs += part.last - part.first
        self.size += len(raw)

    def taken(self) -> pa.RecordBatch:
        raw, start, size, doc, key = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids = pa.concat_arrays(self.ids)
        length = np.bincount(doc, minlength=self.docs).astype(np.uint32)
        order = np.argsort(key, kind="stable")  # documents stay in order within a term
        key, doc = key[order], doc[order]
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = np.flatnonzero(fresh)
        posting = np.flatnonzero(fresh | np.append(True, doc[1:] != doc[:-1])[: len(key)])
        tf = np.diff(posting, append=len(key)).astype(np.uint32)
        lists = np.diff(np.searchsorted(posting, first), append=len(posting)).astype(np.uint32)
        start, size = start[order[first]], size[order[first]]
        row = {
            "n_docs": int(np.count_nonzero(length)), "n_terms": int(length.sum()),
            "vocabulary": pack(key[first], lists, size, _gathered(raw, start, size)),
            "postings": pack(doc[posting], tf),
            "rows": pack(ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), length),
        }
        self.__init__()
        return pa.RecordBatch.from_pylist([row], pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("vocabulary", pa.binary()), ("postings", pa.binary()), ("rows", pa.binary())]))


def index(docs: DataFrame) -> DataFrame:
    """One row per block of documents. ``docs`` has doc_id and text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for part in text.slices(batch):
                block.add(part, batch.column("doc_id").slice(part.first, part.last - part.first))
                if block.size >= BLOCK:
                    yield block.taken()
        if block.docs:
            yield block.taken()

    return durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(text.returned(task), INDEX))


def _known(blob: bytes, keys: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``keys`` those that a block's vocabulary holds, their places there, and the lengths of all its lists."""
    known, lists, size, raw = unpack(blob, np.uint64, np.uint32, np.uint32, np.uint8)
    hit, at = found_in(keys, known)
    end = np.cumsum(size.astype(np.int64))
    here, data = np.flatnonzero(hit), raw.tobytes()
    same = np.array([data[end[p] - size[p] : end[p]] == words[t] for t, p in zip(here, at, strict=True)], bool)
    return here[same], at[same], lists


def _frequencies(indexed: DataFrame, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
    """In how many documents each term stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for blob in batch.column("vocabulary").to_pylist():
                term, at, lists = _known(blob, keys, words)
                total[term] += lists[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(len(keys), np.int64)
    for row in indexed.select("vocabulary").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class _Lists:
    """The lists of a block that a set of terms needs, as contributions to scores, bounded by range."""

    def __init__(self, vocabulary: bytes, postings: bytes, rows: bytes, keys: np.ndarray, words: list[bytes], weight: np.ndarray, n: int, total: int):
        self.ids, null, length = unpack(rows, np.int64, bool, np.uint32)
        self.null = null
        term, at, lists = _known(vocabulary, keys, words)
        doc, tf = unpack(postings, np.uint32, np.uint32)
        first = np.cumsum(lists.astype(np.int64)) - lists
        size = lists[at].astype(np.int64)
        take = np.repeat(first[at], size) + text.spread(size)
        self.doc, tf = doc[take].astype(np.int64), tf[take].astype(np.int64)
        if 50 * int(length.max(initial=0)) * n < 2**63:
            m = 50 + 50 * length.astype(np.int64) * n // total
        else:
            m = np.array([50 + 50 * int(x) * n // total for x in length], np.int64)
        self.gain = np.repeat(weight[term], size) * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        self.start = np.append(0, np.cumsum(size))
        self.slot = np.full(len(keys), -1)
        self.slot[term] = np.arange(len(term))
        self.short = size * SHORT <= len(self.ids)
        self.ranges = (len(self.ids) + RANGE - 1) // RANGE
        # Where the ranges of a long list begin, and its largest contribution in each.
        long = np.flatnonzero(~self.short)
        self.row = np.full(len(term), -1)
        self.row[long] = np.arange(len(long))
        self.cut = np.zeros((len(long), self.ranges + 1), np.int64)
        self.most = np.zeros((len(long), self.ranges), np.int64)
        for k, s in enumerate(long):
            low, high = self.start[s], self.start[s + 1]
            self.cut[k] = low + np.searchsorted(self.doc[low:high], np.arange(self.ranges + 1) * RANGE)
            some = self.cut[k, :-1] < self.cut[k, 1:]
            self.most[k, some] = np.maximum.reduceat(self.gain[: self.cut[k, -1]], self.cut[k, :-1][some])


class _Best:
    """The k best of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bar(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def _answer(block: _Lists, terms: np.ndarray, best: _Best) -> None:
    """Walk a block for one item."""
    slot = block.slot[terms]
    slot = slot[slot >= 0]
    if not len(slot):
        return
    # Term at a time: the short lists become one, in document order.
    short = slot[block.short[slot]]
    size = block.start[short + 1] - block.start[short]
    take = np.repeat(block.start[short], size) + text.spread(size)
    order = np.argsort(block.doc[take], kind="stable")
    held, gain = block.doc[take][order], block.gain[take][order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
    held, gain = held[first], (np.add.reduceat(gain, first) if len(first) else gain)
    cut = np.searchsorted(held, np.arange(block.ranges + 1) * RANGE)
    bound = np.zeros(block.ranges, np.int64)
    some = cut[:-1] < cut[1:]
    if some.any():
        bound[some] = np.maximum.reduceat(gain, cut[:-1][some])
    long = block.row[slot[~block.short[slot]]]
    bound += block.most[long].sum(0)
    # Document at a time over that list and the long ones, range by range where the bounds reach the bar.
    live = np.flatnonzero(bound >= max(best.bar(), 1))
    for step in range(0, len(live), STEP):
        here = live[step : step + STEP]
        here = here[bound[here] >= best.bar()]
        if not len(here):
            continue
        total = np.zeros(len(here) * RANGE, np.int64)
        shift = np.arange(len(here)) * RANGE - here * RANGE
        for low, high, doc, plus in (
            (cut[here], cut[here + 1], held, gain),
            (block.cut[np.ix_(long, here)].ravel(), block.cut[np.ix_(long, here + 1)].ravel(), block.doc, block.gain),
        ):
            size = high - low
            take = np.repeat(low, size) + text.spread(size)
            np.add.at(total, doc[take] + np.repeat(np.resize(shift, len(low)), size), plus[take])
        found = np.flatnonzero(total >= best.bar())
        if len(found):
            doc = found - np.resize(shift, len(here))[found // RANGE]
            best.add(total[found], block.ids[doc], block.null[doc])


def _in_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, a bounded number of bytes at a time."""
    whole = items.select("item_id", "text").groupBy("item_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("text"))).alias("text"))
    held, size = [], 0
    for row in whole.sort("item_id").toLocalIterator():
        held.append((row["item_id"], terms_of(row["text"])))
        size += len(row["text"])
        if size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(indexed: DataFrame, items: list[tuple], k: int, n: int, total: int) -> DataFrame:
    """The k best of every task and item: place of the item, doc_id, score."""
    words = sorted({w for _, terms in items for w in terms}, key=text.hash_of)
    keys = np.array([text.hash_of(w) for w in words], np.uint64)
    place = {w: t for t, w in enumerate(words)}
    asked = [np.array([place[w] for w in terms], np.int64) for _, terms in items]
    df = _frequencies(indexed, keys, words)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in asked]
        for batch in batches:
            for row in batch.select(["vocabulary", "postings", "rows"]).to_pylist():
                block = _Lists(**row, keys=keys, words=words, weight=weight, n=n, total=total)
                for terms, b in zip(asked, best, strict=True):
                    _answer(block, terms, b)
        size = [len(b.score) for b in best]
        ids, null, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("id", "null", "score"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), size)), pa.array(ids, mask=null), pa.array(score)], names=["place", "doc_id", "score"]
        )

    return indexed.select("vocabulary", "postings", "rows").mapInArrow(text.returned(task), "place long, doc_id long, score long")


def search(indexed: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, scores above 0 only. ``items`` has item_id and text."""
    spark: SparkSession = indexed.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    n, total = indexed.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not n:
        return out
    for block in _in_blocks(items):
        names = spark.createDataFrame([(p, i) for p, (i, _) in enumerate(block)], f"place long, item_id {kind}")
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _found(indexed, block, k, n, total).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(best.join(names, "place").select("item_id", "rank", "doc_id", "score"))
    return out
