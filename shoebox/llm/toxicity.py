"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes by distance.

A bounded sample of labelled documents (``EXAMPLES``, those with the least hash of the id) is the index. Its
vocabulary are all words that two or more examples hold. A word weighs (1 + log tf) * idf * its share of trust: ``TRUST`` for a word that
says nothing of the label, up to 1 as the likelihood ratio of its presence in examples of label 1 grows; among
those a word counts no more often than distinct words stand before it, so that copies of one text prove nothing.

The index is a set of files in the shared folder that workers map. Words in few examples have posting lists; the ``LONG`` most frequent words have
their weights laid out by blocks of ``BLOCK`` examples, with the largest weight of each word in each block. Examples are ordered
by label and leading word so that blocks are alike. For a text the short lists are summed for all examples first. The k-th largest sum is a
bar that k examples reach whatever the long lists add; a block whose best sum plus the largest weights of the text's frequent
words stays below the bar is skipped, the others are completed: the k nearest are exact.

A vote is the share of label 1 among the k nearest, weighted by cosine, next to a prior of weight ``PRIOR``. A logistic
curve, fitted on the examples' own votes without themselves, turns it into a probability. Evidence: the nearest examples' ids, for
every text that holds a word of the vocabulary.

A text without any of the words (empty and null ones too) gets the curve's value of the prior vote. Without examples of both
labels the score is the share of label 1 (0 without any). Rows with a null label teach nothing. Repeated rows
are scored each. Cosines are compared at seven digits; ties between examples go to the one earlier in the index. Very long texts are
scored whole. Columns named score or evidence are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm import text
from shoebox.llm.blobs import arrays_of, save
from shoebox.llm.spark import fresh_folder, labelled_sample
from shoebox.session import durable

EXAMPLES = 8192
TRUST = 0.1
HALF = 10.0  # likelihood ratio at which half of the rest of the trust is given
LONG = 512
BLOCK = 64
NEAREST = 25
PRIOR = 1.0
TEXTS = 128  # scored at once: each has a sum per example


class Index(NamedTuple):
    """What tasks are given; the arrays are files of the folder."""

    folder: str
    words: int
    examples: int
    share: float
    curve: tuple[float, float]


class Lists(NamedTuple):
    """The arrays of an index. Places of words: those with short lists have ``column`` -1, the others a row of ``long``."""

    terms: np.ndarray  # sorted word hashes
    weight: np.ndarray  # idf times trust
    column: np.ndarray
    start: np.ndarray  # bounds of each short list
    row: np.ndarray  # its examples
    value: np.ndarray  # and their weights
    long: np.ndarray  # long lists x examples, padded to whole blocks
    largest: np.ndarray  # long lists x blocks
    labels: np.ndarray  # of the examples, and 0 for an absent neighbour
    ids: np.ndarray


KINDS = {"terms": np.uint64, "weight": np.float32, "column": np.int32, "start": np.int64, "row": np.int32, "value": np.float32,
         "long": np.float32, "largest": np.float32, "labels": np.float64, "ids": np.int64}


def _counts(part: text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, count) of a slice, signs at the ends of words left out."""
    raw = text.LOWER[part.raw]
    start, end, doc = text.words(raw, part.bounds)
    for _ in range(3):
        end = end - ((end - start > 1) & _SIGN[raw[end - 1]])
    return doc, text.span_hash(text.prefix(raw), start, end), np.ones(len(doc), np.int64)


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ".,;:!?\"'()|#*$%&"]] = True


def _weighted(part: text.Slice, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the word, weight) of a slice, one entry per document and word, each document of unit length."""
    doc, word, _ = _counts(part)
    if not len(terms) or not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
    hit = terms[at] == word
    pair, tf = np.unique(doc[hit] * len(terms) + at[hit], return_counts=True)
    doc, at = pair // len(terms), pair % len(terms)
    value = (1 + np.log(tf)) * weight[at]
    length = np.sqrt(np.bincount(doc, value * value, part.last - part.first))
    return doc, at, (value / length[doc]).astype(np.float32)


def _likelihood(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of a word's presence in either label."""

    def part(k, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    joint = (df1 + df0) / max(n1 + n0, 1)
    return part(df1, n1, df1 / max(n1, 1)) + part(df0, n0, df0 / max(n0, 1)) - part(df1, n1, joint) - part(df0, n0, joint)


def built(terms: np.ndarray, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> Lists:
    """The lists of examples 0, 1, ... in the order given, from entries (example, word, weight)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    df = np.bincount(term, minlength=len(terms))
    frequent = np.argsort(-df, kind="stable")[:LONG]
    column = np.full(len(terms), -1, np.int32)
    column[frequent] = np.arange(len(frequent))
    long = np.zeros((len(frequent), blocks * BLOCK), np.float32)
    many = column[term] >= 0
    long[column[term[many]], doc[many]] = value[many]
    doc, term, value = doc[~many], term[~many], value[~many]
    order = np.lexsort((doc, term))
    start = np.searchsorted(term[order], np.arange(len(terms) + 1))
    largest = long.reshape(len(frequent), blocks, BLOCK).max(2)
    return Lists(terms, weight, column, start, doc[order].astype(np.int32), value[order], long, largest, np.append(labels, 0.0), np.append(ids, -1))


def nearest(lists: Lists, n: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and place of the k nearest examples of each of n texts, exact; absent ones have cosine 0 and place -1.

    Texts are entries (text, word, weight). ``skip``: for each text an example to leave out.
    """
    examples, blocks = len(lists.ids) - 1, lists.largest.shape[1]
    wide = blocks * BLOCK
    # Short lists, summed for every example.
    column = lists.column[term]
    short = column < 0
    t = term[short]
    size = lists.start[t + 1] - lists.start[t]
    take = np.repeat(lists.start[t], size) + text.spread(size)
    at = np.repeat(doc[short], size) * wide + lists.row[take]
    sums = np.bincount(at, lists.value[take] * np.repeat(value[short], size), n * wide).astype(np.float32).reshape(n, wide)
    asked = np.zeros((n, len(lists.largest)), np.float32)
    asked[doc[~short], column[~short]] = value[~short]
    # What k examples reach at least, and what a block's examples reach at most.
    best = sums.reshape(n, blocks, BLOCK).max(2)
    if skip is not None:
        sums[np.arange(n), skip] = 0
    bar = np.partition(sums, wide - k, axis=1)[:, wide - k] if wide > k else np.zeros(n, np.float32)
    bound = best + asked @ lists.largest + 1e-5
    live = (bound >= bar[:, None]) & (bound > 2e-5)
    cosine = np.full((n, wide), -1, np.float32)
    for b in range(blocks):
        mine = np.flatnonzero(live[:, b])
        if len(mine):
            here = slice(b * BLOCK, (b + 1) * BLOCK)
            cosine[mine, here] = sums[mine, here] + asked[mine] @ lists.long[:, here]
    cosine[:, examples:] = -1
    if skip is not None:
        cosine[np.arange(n), skip] = -1
    # Larger cosine first, then the earlier example, in one integer.
    bits = wide.bit_length()
    rank = np.round(cosine.astype(np.float64) * 1e7).astype(np.int64) << bits | (wide - 1 - np.arange(wide))
    some = min(k, wide)
    top = np.argpartition(-rank, some - 1, axis=1)[:, :some]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(rank, top, 1), axis=1), 1)
    found = np.take_along_axis(cosine, top, 1)
    place = np.where(found > 0, top, -1)
    pad = ((0, 0), (0, k - some))
    return np.pad(np.where(found > 0, found, 0), pad), np.pad(place, pad, constant_values=-1)


def _votes(best: np.ndarray, place: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    weight = np.where(place >= 0, best, 0).astype(np.float64)
    return (PRIOR * share + (weight * labels[place]).sum(1)) / (PRIOR + weight.sum(1))


def _curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' logits, by Newton steps with a light ridge."""
    x = np.stack([_logit(votes), np.ones(len(votes))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3, x.T @ (labels - p) - 1e-3 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _few(part: text.Slice) -> Iterator[text.Slice]:
    for low in range(0, part.last - part.first, TEXTS):
        high = min(low + TEXTS, part.last - part.first)
        a, b = part.bounds[low], part.bounds[high]
        yield text.Slice(part.first + low, part.first + high, part.raw[a:b], part.bounds[low : high + 1] - a, part.null[low:high])


def _opened(index: Index) -> Lists:
    """The arrays of an index, mapped; a missing or short file is an error."""
    files = arrays_of(index.folder)
    lists = Lists(**{name: files.get(name, kind) for name, kind in KINDS.items()})
    wide = -(-index.examples // BLOCK) * BLOCK
    if len(lists.terms) != index.words or len(lists.ids) != index.examples + 1 or len(lists.start) != index.words + 1:
        raise FileNotFoundError(f"not a whole index: {index.folder}")
    return lists._replace(long=lists.long.reshape(-1, wide), largest=lists.largest.reshape(-1, wide // BLOCK))


def _vocabulary(seen: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words in two or more examples, and their weights. The sample bounds their number."""
    of_label = F.col("toxic") == 1
    presence = seen.groupBy("word").agg(
        F.countDistinct("row").alias("df"),
        F.countDistinct(F.when(of_label, F.col("row"))).alias("df1"),
        F.countDistinct(F.when(of_label, F.col("before"))).alias("contexts"),
    )
    found = presence.where("df >= 2").toArrow()
    word = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    df, df1, contexts = (found.column(c).to_numpy().astype(float)[order] for c in ("df", "df1", "contexts"))
    df0, held = df - df1, np.minimum(df1, contexts)
    gain = np.where(held * n0 > df0 * n1, _likelihood(held, df0, n1, n0), 0)
    trust = TRUST + (1 - TRUST) * gain / (gain + HALF)
    return word[order], ((np.log((n1 + n0 + 1) / (df + 1)) + 0.1) * trust).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> Index:
    """Index of at most ``limit`` documents (doc_id, text) that have a label (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, "toxic", limit)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                doc, word, _ = _counts(part)
                before = np.where(np.append(True, doc[1:] != doc[:-1]), np.uint64(0), np.roll(word, 1)) if len(doc) else word
                pair = text.mix(word) ^ before
                _, at = np.unique(text.mix(pair) + doc.astype(np.uint64), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(word[at].view(np.int64)), pa.array(before[at].view(np.int64)),
                        batch.column("row").take(pa.array(part.first + doc[at])), batch.column("toxic").take(pa.array(part.first + doc[at])),
                    ],
                    names=["word", "before", "row", "toxic"],
                )

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = n1 / max(n1 + n0, 1)
    if not (n1 and n0):
        return Index("", 0, 0, share, (1.0, 0.0))
    numbered = sample.withColumn("row", F.monotonically_increasing_id())
    seen = durable(numbered.mapInArrow(text.returned(words), "word long, before long, row long, toxic int"))
    terms, weight = _vocabulary(seen, n1, n0)
    if not len(terms):
        return Index("", 0, 0, share, (1.0, 0.0))
    folder = fresh_folder(docs.sparkSession, "examples", make=True)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                doc, at, value = _weighted(part, terms, weight)
                cut = np.searchsorted(doc, np.arange(part.last - part.first + 1))
                mine = slice(part.first, part.last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[mine], batch.column("toxic")[mine],
                        pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "toxic", "term", "value"],
                )

    def build(rows: pa.Table) -> pa.Table:
        """All examples: ``limit`` bounds them."""
        ids, labels = rows.column("doc_id").fill_null(-1).to_numpy(), rows.column("toxic").to_numpy().astype(float)
        term = [np.frombuffer(x, np.int32) for x in rows.column("term").to_pylist()]
        value = [np.frombuffer(x, np.float32) for x in rows.column("value").to_pylist()]
        lead = np.array([t[v.argmax()] if len(v) else -1 for t, v in zip(term, value, strict=True)])
        order = np.lexsort((ids, lead, labels))
        size = np.array([len(t) for t in term])[order]
        doc = np.repeat(np.arange(len(order)), size)
        term, value = (np.concatenate([x[k] for k in order]) for x in (term, value))
        term = term.astype(np.int64)
        lists = built(terms, weight, doc, term, value, labels[order], ids[order])
        for name, array in lists._asdict().items():
            save(folder, name, np.ascontiguousarray(array, KINDS[name]).ravel())
        votes = np.zeros(len(order))
        first = np.cumsum(size) - size
        for low in range(0, len(order), TEXTS):
            high = min(low + TEXTS, len(order))
            here = slice(first[low], first[high - 1] + size[high - 1])
            best, place = nearest(lists, high - low, doc[here] - low, term[here], value[here], NEAREST, skip=np.arange(low, high))
            votes[low:high] = _votes(best, place, lists.labels, share)
        slope, offset = _curve(votes, labels[order])
        text.give_back()
        return pa.table({"slope": [slope], "offset": [offset]})

    found = sample.mapInArrow(text.returned(vectors), "doc_id long, toxic int, term binary, value binary")
    curve = found.groupBy(F.lit(0).alias("all")).applyInArrow(build, "slope double, offset double").first()
    return Index(folder, len(terms), n1 + n0, share, (curve["slope"], curve["offset"]))


def score(rows: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """The rows without text, with score and the ids of the ``evidence`` nearest examples."""
    rows = rows.drop("score", "evidence")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _opened(index) if index.examples else None
        slope, offset = index.curve
        for batch in batches:
            score, shown = np.full(batch.num_rows, index.share), [[] for _ in range(batch.num_rows)]
            for part in (few for some in text.slices(batch) for few in _few(some)) if lists else ():
                doc, term, value = _weighted(part, lists.terms, lists.weight)
                best, place = nearest(lists, part.last - part.first, doc, term, value, NEAREST)
                mine = slice(part.first, part.last)
                votes = _votes(best, place, lists.labels, index.share)
                score[mine] = 1 / (1 + np.exp(-(slope * _logit(votes) + offset)))
                shown[mine] = [lists.ids[p[p >= 0]].tolist() for p in place[:, :evidence]]
            kept = [k for k, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(score), pa.array(shown, pa.list_(pa.int64()))],
                names=[*(batch.schema.names[k] for k in kept), "score", "evidence"],
            )

    fields = rows.drop("text").schema.fields
    added = [T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(text.returned(task), T.StructType([*fields, *added]))
