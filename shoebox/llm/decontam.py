"""Benchmark decontamination by latent semantic retrieval, then word-sequence and answer checks.

Terms are the words of the benchmark items that stand in at most ``MAX_DF`` of all documents, and the ``RAREST`` words of every
item in any case; other words cannot add to a cosine with an item. Three passes of tasks
over the whole corpus, none of which shuffles texts:

1. document frequencies of the terms;
2. the range of a randomised SVD of the TF-IDF matrix of all passages (disjoint windows of ``PASSAGE`` words): each
   task adds its passages' part of Y = A'A R for a random R; sums of Y give A'A by Nystrom's formula in one pass.
   The items' own rows join the corpus part in a small SVD, so that the latent space holds both;
3. every window of ``PASSAGE`` words (of half as many for items up to that length), a new one each ``STRIDE`` words, is folded
   in; a cosine of ``CANDIDATE`` or more with an item makes a candidate. Around it, runs of one and a half times the item's
   length are compared by the longest common subsequence of words: a leak has ``SURE`` of the item's words, or ``LIKELY`` of
   them and ``ANSWER`` of the item's answer, its last sentence.

What the driver and the tasks hold follows the benchmark's block of ``ITEMS`` items, not the corpus; larger benchmarks go block by block.

A null or empty text, and an item without words, match nothing. Repeated items are reported each. An empty benchmark
leaves all documents clean. Repeated rows are judged each. Extra columns of the documents are kept, ``leaks`` is replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm import text

PASSAGE = 48
STRIDE = 8
MAX_DF = 0.1
RAREST = 8
SKETCH = 64
RANK = 192
ITEMS = 1000
CANDIDATE = 0.4
SURE = 0.8
LIKELY = 0.6
ANSWER = 0.75
CHUNK = 256  # terms of a partial sum
LEAD_BITS = 18
FAN_IN = 64  # groups that partial sums are added in first
LEAKS = "array<struct<item_id: bigint, share: double, answer: double>>"


class Item(NamedTuple):
    item_id: int
    words: list[int]
    answer: list[int]


class Space(NamedTuple):
    terms: np.ndarray  # sorted word hashes
    idf: np.ndarray
    basis: np.ndarray  # terms x rank
    folded: np.ndarray  # items x rank, unit length
    items: list[Item]
    holds: np.ndarray  # terms x items, 1 where the item has the term


def _words(raw_text: str) -> list[int]:
    raw = np.frombuffer(raw_text.encode(), np.uint8)
    return _hashes(raw, np.array([0, len(raw)]))[0].tolist()


def _hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words without signs at their ends, as hashes, and their documents."""
    raw = text.LOWER[raw]
    start, end, doc = text.words(raw, bounds)
    sums = text.prefix(raw)
    for _ in range(2):
        end = end - ((end - start > 1) & _SIGN[raw[end - 1]])
        start = start + ((end - start > 1) & _SIGN[raw[np.minimum(start, len(raw) - 1)]])
    return text.span_hash(sums, start, end), doc


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def item_of(item_id: int, body: str) -> Item:
    words = _words(body)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", body.strip()) if s]
    answer = _words(sentences[-1]) if sentences else []
    return Item(item_id, words, answer if len(answer) >= 3 else words[-5:])


def common(sequence: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, by bits of a whole number."""
    places: dict[int, int] = {}
    for k, w in enumerate(sequence):
        places[w] = places.get(w, 0) | 1 << k
    row = full = (1 << len(sequence)) - 1
    for w in other:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(sequence) - row.bit_count()


def _terms(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each word among the terms, or -1. Most words share their leading bits with no term and are not looked up."""
    top = np.uint64(64 - LEAD_BITS)
    leads = np.zeros(1 << LEAD_BITS, bool)
    leads[terms >> top] = True
    out = np.full(len(hashes), -1, np.int64)
    some = np.flatnonzero(leads[hashes >> top])
    at = np.minimum(np.searchsorted(terms, hashes[some]), len(terms) - 1)
    out[some] = np.where(terms[at] == hashes[some], at, -1)
    return out


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in text.slices(batch):
                hashes, doc = _hashes(part.raw, part.bounds)
                at = _terms(hashes, terms)
                pair = np.unique(doc[at >= 0] * len(terms) + at[at >= 0])
                found += np.bincount(pair % len(terms), minlength=len(terms))
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.append(used, -1), "docs": np.append(found[used], rows)})

    rows = docs.select("text").mapInArrow(text.returned(task), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    counts = {r["term"]: r["docs"] for r in rows}
    return np.array([counts.get(k, 0) for k in range(len(terms))], np.float64), counts.get(-1, 0)


def _range(docs: DataFrame, terms: np.ndarray, idf: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Y = A'A R over all passages of the corpus."""
    weighted = (idf[:, None] * sketch).astype(np.float32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(terms), sketch.shape[1]))
        for batch in batches:
            for part in text.slices(batch):
                hashes, doc = _hashes(part.raw, part.bounds)
                if not len(hashes):
                    continue
                opens = np.append(True, doc[1:] != doc[:-1])
                first = np.flatnonzero(opens)
                nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
                passage = np.cumsum(opens | (nth % PASSAGE == 0)) - 1
                at = _terms(hashes, terms)
                passage, at = passage[at >= 0], at[at >= 0]
                if not len(at):
                    continue
                begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                folded = np.add.reduceat(weighted[at], begins, axis=0)
                owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
                order = np.argsort(at, kind="stable")
                cut = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
                total[at[order][cut]] += np.add.reduceat(folded[owner[order]], cut, axis=0)
        turn = TaskContext.get().partitionId() % FAN_IN
        for k in range(0, len(terms), CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": [k], "turn": [turn], "part": [total[k : k + CHUNK].tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("part").to_pylist())
        total = np.sum([np.frombuffer(p) for p in parts], axis=0)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("part"), "part", pa.array([total.tobytes()], pa.binary()))

    schema = "chunk long, turn long, part binary"
    parts = docs.select("text").mapInArrow(text.returned(task), schema).groupBy("chunk", "turn").applyInArrow(add, schema)
    rows = parts.groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros((len(terms), sketch.shape[1]))
    for r in rows:
        block = np.frombuffer(r["part"]).reshape(-1, sketch.shape[1])
        out[r["chunk"] : r["chunk"] + len(block)] = block
    return idf[:, None] * out


def space(docs: DataFrame, items: list[Item]) -> Space | None:
    """The latent space of the corpus's passages and the items."""
    items = [i for i in items if i.words]
    if not items:
        return None
    terms = np.unique(np.array([w for i in items for w in i.words], np.uint64))
    df, n = _frequencies(docs, terms)
    kept = df <= MAX_DF * n
    for item in items:
        own = _terms(np.unique(np.array(item.words, np.uint64)), terms)
        kept[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
    terms, df = terms[kept], df[kept]
    idf = np.log((n + 1) / (df + 1)) + 0.1
    rows = np.zeros((len(items), len(terms)))
    for k, item in enumerate(items):
        own = _terms(np.array(item.words, np.uint64), terms)
        np.add.at(rows[k], own[own >= 0], 1)
    rows *= idf
    sketch = np.random.default_rng(text.SEED).standard_normal((len(terms), min(SKETCH, len(terms))))
    y = _range(docs, terms, idf, sketch)
    # Nystrom: A'A is about Y (R'Y)^-1 Y', of which a root is found by an eigenvalue step.
    core = sketch.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(initial=0) * 1e-10, 1e-12)
    root = (y @ (vector[:, good] / np.sqrt(value[good]))).T
    # The items weigh as much as the corpus.
    scale = np.linalg.norm(root) / max(np.linalg.norm(rows), 1e-12) or 1.0
    _, _, axes = np.linalg.svd(np.vstack([root, rows * scale]), full_matrices=False)
    basis = axes[: max(RANK, len(items))].T
    folded = rows @ basis
    folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
    return Space(terms, idf, (idf[:, None] * basis).astype(np.float32), folded.astype(np.float32), items, (rows > 0).T.astype(np.uint8, order="C"))


def _windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word (in its document) of every window."""
    many = np.where(counts > 0, np.maximum(-(-(counts - size) // STRIDE), 0) + 1, 0)
    return np.repeat(np.arange(len(counts)), many), text.spread(many) * STRIDE


def compared(item: Item, region: list[int]) -> tuple[float, float]:
    """Best share of the item's words in a run of the region, and of its answer there."""
    n = len(item.words)
    run = n + n // 2
    best = (0.0, 0.0)
    if len(set(item.words).intersection(region)) < LIKELY * len(set(item.words)):  # no subsequence has more kinds of words
        return best
    for a in range(0, max(len(region) - run, 0) + 1, max(n // 4, 1)):
        near = region[a : a + run + n // 4]
        best = max(best, (common(item.words, near) / n, common(item.answer, near) / len(item.answer)))
    return best


def _possible(doc: np.ndarray, term: np.ndarray, docs: int, at: Space) -> np.ndarray:
    """documents x items: whether the kinds of an item's words in the whole document can be ``LIKELY`` of them, as ``compared``
    asks of any part; words that are no terms count as present."""
    pair = np.unique(doc * len(at.terms) + term)
    owner, held = pair // len(at.terms), at.holds[pair % len(at.terms)]
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    kinds = np.array([len(set(i.words)) for i in at.items])
    found = np.zeros((docs, len(kinds)), np.int32)
    found[owner[begins]] = np.add.reduceat(held, begins, axis=0, dtype=np.int32)
    return found + (kinds - at.holds.sum(axis=0, dtype=np.int64)) >= LIKELY * kinds


def _leaks(part: text.Slice, at: Space) -> list[dict[int, tuple[float, float]]]:
    """For each document, the items it leaks with the best shares."""
    docs = part.last - part.first
    out: list[dict] = [{} for _ in range(docs)]
    hashes, doc = _hashes(part.raw, part.bounds)
    term = _terms(hashes, at.terms)
    has = np.flatnonzero(term >= 0)
    if not len(has):
        return out
    counts = np.bincount(doc, minlength=docs)
    first = np.cumsum(counts) - counts
    term, doc = term[has], doc[has]
    # Sums of folded words over strides, then over the strides of a window.
    strides = -(-counts // STRIDE)
    head = np.cumsum(strides) - strides
    row_doc = np.repeat(np.arange(docs), strides)
    stride_of = head[doc] + (has - first[doc]) // STRIDE
    sums = np.zeros((len(row_doc), at.basis.shape[1]), np.float32)
    begins = np.flatnonzero(np.append(True, stride_of[1:] != stride_of[:-1]))
    many = np.diff(np.append(begins, len(has)))
    sums[stride_of[begins]] = at.basis[term[begins]]
    for k in range(1, int(many.max())):
        more = begins[many > k] + k
        sums[stride_of[more]] += at.basis[term[more]]
    possible = _possible(doc, term, docs, at)
    short = np.array([len(i.words) <= PASSAGE // 2 for i in at.items])
    rolling, upto = sums.copy(), 1
    for size, mine in ((PASSAGE // 2, np.flatnonzero(short)), (PASSAGE, np.flatnonzero(~short))):
        if not len(mine):
            continue
        while upto < size // STRIDE:
            ends = np.flatnonzero(row_doc[:-upto] != row_doc[upto:])  # the stride so far on is another document's
            whole = rolling[ends]
            rolling[:-upto] += sums[upto:]
            rolling[ends] = whole
            upto += 1
        owner, start = _windows(counts, size)
        folded = rolling[head[owner] + start // STRIDE]
        length = np.linalg.norm(folded, axis=1)
        some = np.flatnonzero(length > 0)
        folded, length, owner, start = folded[some], length[some], owner[some], start[some]
        near = np.flatnonzero(folded @ at.folded[mine].T >= CANDIDATE * length[:, None])
        w, k = near // len(mine), near % len(mine)
        # A candidate of which the whole document has too few words is not compared.
        left = np.flatnonzero(possible[owner[w], mine[k]])
        left = left[np.argsort(k[left], kind="stable")]
        w, k = w[left], k[left]
        if not len(k):
            continue
        # Neighbouring candidate windows of one item are one region.
        fresh = np.append(True, (k[1:] != k[:-1]) | (owner[w[1:]] != owner[w[:-1]]) | (start[w[1:]] > start[w[:-1]] + size))
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(k)) - 1
        for item_at, doc_at, low, high in zip(
            mine[k[begin]].tolist(), owner[w[begin]].tolist(), start[w[begin]].tolist(), start[w[last]].tolist(), strict=True
        ):
            item = at.items[item_at]
            n = len(item.words)
            a = first[doc_at] + max(low - n, 0)
            b = first[doc_at] + min(high + size + n, counts[doc_at])
            share, answer = compared(item, hashes[a:b].tolist())
            if share >= SURE or (share >= LIKELY and answer >= ANSWER):
                out[doc_at][item_at] = max(out[doc_at].get(item_at, (0.0, 0.0)), (share, answer))
    return out


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with ``leaks``: the items found in each and how much of them."""
    docs = docs.drop("leaks")
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    blocks = max(1, -(-rows.count() // ITEMS))
    out = docs.withColumn("leaks", F.array().cast(LEAKS))
    for block in range(blocks):
        here = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        found = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in here.collect())
        latent = space(docs, [item_of(*r) for r in found])
        if latent is not None:
            out = _marked(out, latent)
    return out


def _marked(docs: DataFrame, latent: Space) -> DataFrame:
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(latent))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pickle.loads(blob.value)
        for batch in batches:
            before = batch.column("leaks").to_pylist()
            found = [x for part in text.slices(batch) for x in _leaks(part, at)]
            leaks = [
                [*(old or []), *({"item_id": at.items[k].item_id, "share": s, "answer": a} for k, (s, a) in sorted(new.items()))]
                for old, new in zip(before, found, strict=True)
            ]
            place = batch.schema.get_field_index("leaks")
            yield batch.set_column(place, "leaks", pa.array(leaks, _ARROW_LEAKS))

    return docs.mapInArrow(text.returned(task), T.StructType(docs.schema.fields))


_ARROW_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("answer", pa.float64())]))
