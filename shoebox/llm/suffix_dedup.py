"""Exact-substring removal by a collection Burrows-Wheeler transform, built column by column over anchored segments.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

A transform over whole documents would take as many rounds as the longest has bytes. So each document is first cut into
overlapping segments at anchors: in every window of LENGTH bytes the ``GRAM``-byte string with the least hash (the leftmost
of equals) is one. Equal windows have equal anchors at the same place, so both lie in segments, LENGTH - GRAM bytes to the
left of the anchor and LENGTH from it on, that line up column by column; and segments with different anchors share no window.
A first pass writes the hashes of anchors in more than one document as sorted external files; a second one reads them in order and
deals only segments of such anchors, by anchor, into sequential blobs, equal ones of a task written once with their places.

A shard then builds the transform of its distinct segments, those whose anchor stands in more than one document, from the last
column to the first. Each round inserts one symbol per segment: a stable sort by the new symbol turns the order of suffixes from the next
column into that of this one, and the first column at which neighbours differ (the common prefix) is a range minimum over the old order.
Runs of neighbours with LENGTH common bytes are the equal windows of a column; the least id of a run decides for each of its places.
The windows of one place overlap, so each place has one span at most. Spans meet by document and are merged there.

Ids: nulls sort last and never remove from each other; rows with one id do not remove from each other, but others' copies
from both. A null text is empty, with one byte string removed from none. Ties inside a document do not count. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm import text
from shoebox.llm.blobs import BLOBS, arrays_of, by_shard, dealt, found_in, pack, save, unpack
from shoebox.llm.spark import fresh_folder
from shoebox.session import durable

LENGTH = 50
GRAM = 16
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
FLUSH = 12 << 20  # bytes of segments a task holds
NULL_ID = np.iinfo(np.int64).max
PLACE_BITS = np.uint64(28)  # a text of up to 256 MiB; the rest of 64 bits ranks the anchors
SPANS = "doc_id long, body long, spans array<bigint>"


def _anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and document of every anchor of a slice."""
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    sums = text.prefix(raw)
    at = np.arange(len(raw) - GRAM + 1)
    ranked = text.span_hash(sums, at, at + GRAM) >> PLACE_BITS << PLACE_BITS | at.astype(np.uint64)
    least, span = ranked, 1
    while span * 2 <= LEFT + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = LEFT + 1 - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(n), "right") - 1
    inside = np.arange(n) + LENGTH <= bounds[doc + 1]
    place, doc = place[inside], doc[inside]
    fresh = np.append(True, (place[1:] != place[:-1]))[: len(place)]
    return place[fresh], doc[fresh]


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _anchor_hashes(part: text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document and 48-bit hash of every anchor of a slice; what a clash lets through, the bytes take out again."""
    place, doc = _anchors(part.raw, part.bounds)
    sums = text.prefix(part.raw)
    return place, doc, text.span_hash(sums, place, place + GRAM) >> np.uint64(16)


def _repeated(docs: DataFrame, shards: int) -> str:
    """A folder with a sorted array per shard: the anchors that stand in more than one row."""
    folder = fresh_folder(docs.sparkSession, "anchors", make=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, rows = 0, 0

        def flush():
            row, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first)
            key = key[first]
            return dealt(_shard(key, shards), shards, (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16), several)

        for batch in batches:
            for part in text.slices(batch):
                place, doc, key = _anchor_hashes(part)
                held.append((rows + part.first + doc, key))
                size += len(part.raw)
                if size >= FLUSH:
                    yield flush()
                    size = 0
            rows += batch.num_rows
        if sum(len(h[1]) for h in held):
            yield flush()

    def keep(table: pa.Table) -> pa.Table:
        parts = [unpack(b, np.uint32, np.uint16, np.bool_) for b in table.column("blob").to_pylist()]
        high, low, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at, count = np.unique(high.astype(np.uint64) << np.uint64(16) | low, return_inverse=True, return_counts=True)
        again = (count > 1) | (np.bincount(at, several) > 0)
        save(folder, f"again-{table.column('shard')[0].as_py()}", key[again])
        text.give_back()
        return pa.table({"n": pa.array([int(again.sum())], pa.int64())})

    docs.select("text").mapInArrow(text.returned(task), BLOBS).groupBy("shard").applyInArrow(keep, "n long").agg(F.sum("n")).collect()
    return folder


def _segments(docs: DataFrame, shards: int, folder: str) -> DataFrame:
    """Blobs of distinct segments with repeated anchors and of their places, by shard of the anchor."""

    def repeated(key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        for s, mine in by_shard(key, _shard(key, shards), shards):
            out[mine] = found_in(key[mine], arrays_of(folder).get(f"again-{s}", np.uint64))[0]
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, shard, cells, doc_id, body, place, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, first, same = np.unique(key, return_index=True, return_inverse=True)
            # Places are dealt with their segment: the segments of a shard are numbered in its blob.
            order = np.argsort(shard[first], kind="stable")
            cut = np.searchsorted(shard[first][order], np.arange(shards + 1))
            number = np.empty(len(distinct), np.int64)
            number[order] = np.arange(len(distinct)) - cut[shard[first][order]]
            by_shard = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            rows = []
            for s in range(shards):
                if cut[s] < cut[s + 1]:
                    mine, all_of = first[order[cut[s] : cut[s + 1]]], by_shard[ends[s] : ends[s + 1]]
                    rows.append(
                        (s, pack(
                            cells[mine].ravel(), before[mine], after[mine],
                            number[same[all_of]].astype(np.uint32), doc_id[all_of], body[all_of], place[all_of],
                        ))
                    )
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            ids, bodies = np.asarray(batch.column("doc_id").fill_null(NULL_ID)), np.asarray(batch.column("body"))
            for part in text.slices(batch):
                place, doc, anchor = _anchor_hashes(part)
                kept = repeated(anchor)
                place, doc, anchor = place[kept], doc[kept], anchor[kept]
                if not len(place):
                    continue
                before = np.minimum(place - part.bounds[doc], LEFT)
                after = np.minimum(part.bounds[doc + 1] - place, LENGTH)
                column = np.arange(WIDTH) - LEFT
                source = place[:, None] + column
                known = (column >= -before[:, None]) & (column < after[:, None])
                cells = np.where(known, part.raw[np.clip(source, 0, len(part.raw) - 1)], 0).astype(np.uint8)
                sums = text.prefix(part.raw)
                key = text.mix(text.span_hash(sums, place - before, place + after) + (before * 64 + after).astype(np.uint64))
                row = part.first + doc
                held.append((key, _shard(anchor, shards), cells, ids[row], bodies[row], (place - part.bounds[doc]).astype(np.uint32), before.astype(np.uint8), after.astype(np.uint8)))
                size += len(place) * WIDTH
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(text.returned(task), BLOBS)


def _least_ids(cells: np.ndarray, before: np.ndarray, after: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each segment and window column, the least id with that window; the largest value where there is no whole window."""
    n = len(cells)
    out = np.full((n, LEFT + 1), NULL_ID, np.int64)
    order = np.arange(n)
    differ = np.full(n, WIDTH, np.int64)  # first column at which a row differs from the one before it in the order
    for column in range(WIDTH - 1, -1, -1):
        symbol = cells[order, column]
        turn = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[turn]
        fresh = np.full(n, column, np.int64)
        same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1]) + 1
        if len(same):
            low, high = turn[same - 1] + 1, turn[same] + 1
            pairs = np.stack([low, high], 1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(differ, WIDTH), pairs)[::2]
        order, differ = order[turn], fresh
        if column <= LEFT:
            whole = (before[order] >= LEFT - column) & (after[order] >= LENGTH - LEFT + column)
            begins = np.flatnonzero(differ < column + LENGTH)
            if not len(begins) or begins[0]:
                begins = np.append(0, begins)
            ids = np.where(whole, least[order], NULL_ID)
            run = np.repeat(np.minimum.reduceat(ids, begins), np.diff(np.append(begins, n)))
            out[order[whole], column] = run[whole]
    return out


def _matched(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, body, start, end) of the span of each place that has one."""
    kinds = (np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.int64, np.uint32)
    parts = [unpack(b, *kinds) for b in table.column("blob").to_pylist()]
    shift = np.cumsum([0, *(len(p[1]) for p in parts)])
    cells = np.concatenate([p[0] for p in parts]).reshape(-1, WIDTH)
    before, after = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    segment = np.concatenate([p[3] + s for p, s in zip(parts, shift, strict=False)]).astype(np.int64)
    doc_id, body, place = (np.concatenate([p[k] for p in parts]) for k in (4, 5, 6))
    key = before.astype(np.uint64) * np.uint64(64) + after
    for k in range(0, WIDTH - 8 + 1, 8):
        key = text.mix(key + np.ascontiguousarray(cells[:, k : k + 8]).view(np.uint64)[:, 0])
    key = text.mix(key + np.ascontiguousarray(cells[:, WIDTH - 8 :]).view(np.uint64)[:, 0])
    # One row per distinct segment; should two have one key, the bytes keep them apart.
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    odd = np.flatnonzero((cells != cells[first[same]]).any(1) | (before != before[first[same]]) | (after != after[first[same]]))
    same[odd] = len(first) + np.arange(len(odd))
    rep = np.append(first, odd)
    row = same[segment]
    least, most = np.full(len(rep), NULL_ID), np.full(len(rep), np.iinfo(np.int64).min)
    np.minimum.at(least, row, doc_id)
    np.maximum.at(most, row, doc_id)
    # Only anchors in more than one document.
    anchor = np.ascontiguousarray(cells[rep, LEFT : LEFT + GRAM]).view(np.uint64)
    _, group = np.unique(text.mix(anchor[:, 0]) + anchor[:, 1], return_inverse=True)
    low, high = np.full(group.max(initial=-1) + 1, NULL_ID), np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, most)
    several = (low < high)[group]
    kept = np.flatnonzero(several)
    renumber = np.full(len(rep), -1, np.int64)
    renumber[kept] = np.arange(len(kept))
    ids = _least_ids(cells[rep[kept]], before[rep[kept]], after[rep[kept]], least[kept]) if len(kept) else np.zeros((0, LEFT + 1), np.int64)
    row = renumber[row]
    lowest = ids.min(1) if len(ids) else np.zeros(0, np.int64)
    use = np.flatnonzero(row >= 0)
    use = use[lowest[row[use]] < doc_id[use]]
    start, end = np.zeros(len(use), np.int64), np.zeros(len(use), np.int64)
    for k in range(0, len(use), 1 << 18):
        some = use[k : k + (1 << 18)]
        hit = ids[row[some]] < doc_id[some][:, None]
        start[k : k + len(some)] = place[some].astype(np.int64) - LEFT + hit.argmax(1)
        end[k : k + len(some)] = place[some].astype(np.int64) + LENGTH - hit[:, ::-1].argmax(1)
    return doc_id[use], body[use], start, end


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans per owner, of spans sorted by owner and start; touching ones are one."""
    if not len(owner):
        return owner, start, end
    group = np.append(0, np.cumsum(owner[1:] != owner[:-1]))
    base = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] + base[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], (reach - base)[last]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text) and the byte spans to remove, as start, end, start, ..., for documents that lose bytes.

    ``docs`` has doc_id and text.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def match(table: pa.Table) -> pa.Table:
        doc_id, body, start, end = _matched(table)
        text.give_back()
        order = np.lexsort((start, body, doc_id))
        doc_id, body, start, end = doc_id[order], body[order], start[order], end[order]
        shard = (text.mix(body.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        batch = dealt(shard, shards, doc_id, body, start.astype(np.uint32), end.astype(np.uint32))
        return pa.Table.from_batches([batch])

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b, np.int64, np.int64, np.uint32, np.uint32) for b in table.column("blob").to_pylist()]
        doc_id, body, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, body, doc_id))
        doc_id, body, start, end = doc_id[order], body[order], start[order].astype(np.int64), end[order].astype(np.int64)
        owner = np.append(0, np.cumsum((doc_id[1:] != doc_id[:-1]) | (body[1:] != body[:-1])))
        who, start, end = _merged(owner, start, end)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        flat = np.stack([start, end], 1).ravel()
        offsets = np.append(np.searchsorted(who, np.arange(len(first))), len(who)) * 2
        ids = pa.array(doc_id[first], mask=doc_id[first] == NULL_ID)
        return pa.table({"doc_id": ids, "body": pa.array(body[first]), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))})

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("body", F.xxhash64("text"))
    found = durable(_segments(rows, shards, _repeated(rows, shards)).groupBy("shard").applyInArrow(match, BLOBS))
    return durable(found.groupBy("shard").applyInArrow(merge, SPANS))


def with_spans(docs: DataFrame, found: DataFrame, name: str = "spans") -> DataFrame:
    """The documents with their spans, null where nothing goes. One row per text in ``found``, so no row is repeated."""
    body = F.xxhash64("text")
    right = found.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("spans").alias(name))
    same = docs["doc_id"].cast("long").eqNullSafe(right["_id"]) & (body == right["_body"])
    return docs.join(right.hint("shuffle_hash"), same, "left").drop("_id", "_body")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 from doc_id, text and spans."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("spans").to_pylist()
            size, removed, count, kept = [], [], [], []
            for part in text.slices(batch):
                data = memoryview(part.raw)
                for k in range(part.last - part.first):
                    a, b = int(part.bounds[k]), int(part.bounds[k + 1])
                    cut = gone[part.first + k] or []
                    h = hashlib.sha256()
                    for low, high in zip([0, *cut[1::2]], [*cut[::2], b - a], strict=True):
                        h.update(data[a + low : a + high])
                    size.append(b - a)
                    removed.append(sum(cut[1::2]) - sum(cut[::2]))
                    count.append(len(cut) // 2)
                    kept.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(text.returned(task), schema)


def trimmed(body: Column, gone: Column) -> Column:
    """The text without its spans; a character goes only if all its bytes do."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for value, span in zip(texts, spans, strict=True):
            if value is None or span is None or not len(span):
                out.append(value)
                continue
            data, at, kept = value.encode(), 0, []
            for low, high in zip(span[::2], span[1::2], strict=True):
                low, high = int(low), int(high)
                while low < high and data[low] & 0xC0 == 0x80:
                    low += 1
                while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                    high -= 1
                kept.append(data[at:low])
                at = max(high, low)
            kept.append(data[at:])
            out.append(b"".join(kept).decode())
        import pandas as pd

        return pd.Series(out)

    return cut(body, gone)
