"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are 64-bit hashes. Tasks count bigrams of their texts into blobs, one per shard, and a shard adds up its blobs:
what moves is one entry per distinct bigram and task. A shard is picked by the context word; a context with more than
1/HOT_SHARE of all tokens (fewer than HOT_SHARE such words exist) is spread over all shards by the whole bigram instead, so
no shard is hot. Every shard writes its sorted arrays below the shared folder; only sums and the hot words pass the driver.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v.) + g(v) p(w),   p(w) = max(n(.w) - D(n(.w)), 0) / n(..) + g / (V + 1)

n(.w) counts distinct words before w; D has three values per order from the counts of counts; g is the discounted
mass; V counts distinct tokens, the end included. A context never seen leaves p(w). Unknown words share g / (V + 1).

Scoring: each worker maps the shard arrays (from a local or mounted folder in place, otherwise from a copy that is unlinked
at once) and looks up the sorted distinct keys of a slice of texts, so pages are read in order and memory is the page cache's.

A null text is empty: its one token is the end. An empty training set leaves every token unknown (score and base
score of log10 of 1 / (V + 1) with V = 0: zero). Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import text
from shoebox.llm.blobs import BLOBS, arrays_of, by_shard, dealt, found_in, pack, save, unpack
from shoebox.llm.spark import HOT_SHARE, fresh_folder
from shoebox.session import durable

START = np.uint64(1)  # no word: words are hashes of at least one byte
END = np.uint64(2)
HELD = 2_000_000  # distinct bigrams a counting task holds before it hands them on


class Model(NamedTuple):
    folder: str
    shards: int
    hot: np.ndarray  # sorted hashes of hot contexts
    hot_total: np.ndarray
    hot_kinds: np.ndarray  # contexts x 3: continuations seen once, twice, more often
    discounts: np.ndarray  # 2 orders x 3
    tokens: int
    types: int
    bigram_types: int
    lower_kinds: np.ndarray  # words preceded by one, two, more distinct words


def _tokens(part: text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token and of the one before it, and the document; every document ends with END."""
    raw = text.LOWER[part.raw]
    start, end, doc = text.words(raw, part.bounds)
    hashes = text.span_hash(text.prefix(raw), start, end)
    docs = part.last - part.first
    after = np.searchsorted(doc, np.arange(docs), "right")
    word = np.insert(hashes, after, END)
    owner = np.insert(doc, after, np.arange(docs))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[0] = START
    before[1:][owner[1:] != owner[:-1]] = START
    return word, before, owner


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return text.mix(before * np.uint64(0x9FB21C651E98DF25) + word)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _pair_shard(before: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return _shard(np.where(_member(before, hot), key, text.mix(before)), shards)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sum of its counts."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
    return ordered[first], order[first], np.add.reduceat(count[order], first) if len(key) else count


def _words(docs: DataFrame, shards: int) -> DataFrame:
    """Blobs of (word, count) by shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def flush():
            key, _, count = _summed(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [key], [count]

        for batch in batches:
            for part in text.slices(batch):
                key, count = np.unique(_tokens(part)[0], return_counts=True)
                keys.append(key)
                counts.append(count)
                if sum(map(len, keys)) > 2 * HELD:
                    flush()
                    if len(keys[0]) > HELD:
                        yield dealt(_shard(keys[0], shards), shards, keys.pop(), counts.pop())
        if keys:
            flush()
            yield dealt(_shard(keys[0], shards), shards, keys[0], counts[0])

    return docs.select("text").mapInArrow(task, BLOBS)


def _bigrams(docs: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """Blobs of (contexts, words per context, words, counts) by shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged():
            before, word, count = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, total = _summed(_pair(before, word), count)
            return before[at], word[at], total

        def out(before, word, count):
            order = np.argsort(before, kind="stable")
            before, word, count = before[order], word[order], count[order].astype(np.uint32)
            shard = _pair_shard(before, _pair(before, word), hot, shards)
            return dealt(shard, shards, before, word, count)

        for batch in batches:
            for part in text.slices(batch):
                word, before, _ = _tokens(part)
                _, at, count = np.unique(_pair(before, word), return_index=True, return_counts=True)
                held.append((before[at], word[at], count))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return docs.select("text").mapInArrow(task, BLOBS)


def _kinds(count: np.ndarray) -> list[np.ndarray]:
    return [count == 1, count == 2, count >= 3]


def fit(docs: DataFrame, shards: int | None = None) -> Model:
    """Count the column text of all rows and store the model in the shared folder."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_folder(spark, "lm", make=True)
    sums = "tokens long, types long, n1 long, n2 long, n3 long, n4 long, m1 long, m2 long, m3 long, total long"

    def add_words(table: pa.Table) -> pa.Table:
        parts = [unpack(b, np.uint64, np.int64) for b in table.column("blob").to_pylist()]
        key, _, count = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([pack(key, count)], pa.binary())})

    words = durable(_words(docs, shards).groupBy("shard").applyInArrow(add_words, BLOBS))

    def sizes(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                count = unpack(blob, np.uint64, np.int64)[1]
                yield pa.RecordBatch.from_pydict({"tokens": [int(count.sum())], "types": [len(count)]})

    found = words.mapInArrow(sizes, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = found[0] or 0, found[1] or 0

    def hot_words(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                key, count = unpack(blob, np.uint64, np.int64)
                yield pa.RecordBatch.from_pydict({"word": key[count * HOT_SHARE > n_tokens].view(np.int64)})

    hot = np.array([r[0] for r in words.mapInArrow(hot_words, "word long").collect()], np.int64).view(np.uint64)
    hot = np.sort(np.append(hot, START))

    def add_bigrams(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [unpack(b, np.uint64, np.uint64, np.uint32) for b in table.column("blob").to_pylist()]
        before, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at, total = _summed(_pair(before, word), count.astype(np.int64))
        before, word = before[at], word[at]
        over = np.flatnonzero(total > 254)
        save(folder, f"pair-{shard}", key)
        save(folder, f"count-{shard}", np.minimum(total, 255).astype(np.uint8))
        save(folder, f"over-{shard}", np.stack([over, total[over]]).astype(np.int64).ravel())
        context, group = np.unique(before, return_inverse=True)
        size = np.bincount(group, total, len(context)).astype(np.int64)
        kinds = np.stack([np.bincount(group, k, len(context)).astype(np.int64) for k in _kinds(total)], 1)
        cold = ~_member(context, hot)
        save(folder, f"context-{shard}", context[cold])
        save(folder, f"mass-{shard}", np.column_stack([size, kinds])[cold].ravel())
        later, before_it = np.unique(word, return_counts=True)
        blobs = dealt(_shard(later, shards), shards, later, before_it)
        n = blobs.num_rows
        # Rows of kind 0: continuation counts by shard; 1: counts of counts; 2: a hot context's mass.
        warm = np.flatnonzero(~cold)
        kind = [0] * n + [1] + [2] * len(warm)
        values = [None] * n + [[int((total == k).sum()) for k in (1, 2, 3, 4)] + [len(key)]]
        values += [[int(size[k]), *kinds[k].tolist()] for k in warm]
        return pa.table(
            {
                "kind": pa.array(kind, pa.int32()),
                "shard": pa.array(blobs.column("shard").to_pylist() + [shard] * (1 + len(warm)), pa.int32()),
                "word": pa.array([0] * (n + 1) + context[warm].view(np.int64).tolist(), pa.int64()),
                "blob": pa.array(blobs.column("blob").to_pylist() + [None] * (1 + len(warm)), pa.binary()),
                "values": pa.array(values, pa.list_(pa.int64())),
            }
        )

    counted = _bigrams(docs, hot, shards).groupBy("shard").applyInArrow(add_bigrams, "kind int, shard int, word long, blob binary, values array<long>")
    counted = durable(counted)

    def sum_values(kind: int, n: int) -> list:
        rows = counted.where(F.col("kind") == kind)
        return rows.groupBy("word").agg(*(F.sum(F.get("values", F.lit(k))).alias(f"v{k}") for k in range(n))).collect()

    upper = (sum_values(1, 5) or [(0, 0, 0, 0, 0, 0)])[0][1:]
    masses = {np.int64(r[0]).astype(np.uint64).item(): r[1:] for r in sum_values(2, 4)}
    mass = np.array([masses.get(int(h), (0, 0, 0, 0)) for h in hot], np.int64)

    def add_lower(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unpack(r["blob"], np.uint64, np.int64) for r in rows]
        word = np.concatenate([p[0] for p in parts])
        raw = np.concatenate([p[1] if r["raw"] else np.zeros_like(p[1]) for p, r in zip(parts, rows, strict=True)])
        distinct = np.concatenate([np.zeros_like(p[1]) if r["raw"] else p[1] for p, r in zip(parts, rows, strict=True)])
        key, _, count = _summed(word, raw)
        _, _, kinds = _summed(word, distinct)
        shard = rows[0]["shard"]
        save(folder, f"word-{shard}", key)
        save(folder, f"seen-{shard}", np.column_stack([count, kinds]).ravel())
        values = [*((kinds == k).sum() for k in (1, 2, 3, 4)), *(k.sum() for k in _kinds(kinds)), kinds.sum()]
        return pa.table({n: pa.array([int(v)], pa.int64()) for n, v in zip(("n1", "n2", "n3", "n4", "m1", "m2", "m3", "total"), values, strict=True)})

    every = words.select("shard", "blob", F.lit(True).alias("raw")).unionByName(
        counted.where("kind = 0").select("shard", "blob", F.lit(False).alias("raw"))
    )
    lower = every.groupBy("shard").applyInArrow(add_lower, sums.split("types long, ")[1])
    totals = [x or 0 for x in lower.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "m1", "m2", "m3", "total"))).first()]
    discounts = np.array([_discounts(*upper[:4]), _discounts(*totals[:4])])
    return Model(folder, shards, hot, mass[:, 0], mass[:, 1:], discounts, n_tokens, n_types, totals[7], np.array(totals[4:7]))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts; where a count is missing, 0.5, 1 and 1.5 (each below its count)."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(found))


def _log_probs(model: Model, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(word | before), and each word's training count."""
    arrays = arrays_of(model.folder)

    def discount(order, count):
        return np.append(0, model.discounts[order])[np.minimum(count, 3)]

    words, word_at = np.unique(word, return_inverse=True)
    seen = np.zeros((len(words), 2), np.int64)
    for s, mine in by_shard(words, _shard(words, model.shards), model.shards):
        hit, at = found_in(words[mine], arrays.get(f"word-{s}", np.uint64))
        seen[mine[hit]] = arrays.get(f"seen-{s}", np.int64).reshape(-1, 2)[at]
    rest = float(model.discounts[1] @ model.lower_kinds) / model.bigram_types if model.bigram_types else 1.0
    single = np.maximum(seen[:, 1] - discount(1, seen[:, 1]), 0) / max(model.bigram_types, 1) + rest / (model.types + 1)
    contexts, context_at = np.unique(before, return_inverse=True)
    mass = np.zeros((len(contexts), 4), np.int64)
    for s, mine in by_shard(contexts, _shard(text.mix(contexts), model.shards), model.shards):
        hit, at = found_in(contexts[mine], arrays.get(f"context-{s}", np.uint64))
        mass[mine[hit]] = arrays.get(f"mass-{s}", np.int64).reshape(-1, 4)[at]
    hit, at = found_in(contexts, model.hot)
    mass[hit] = np.column_stack([model.hot_total, model.hot_kinds])[at]
    total = mass[:, 0]
    back = np.where(total > 0, mass[:, 1:] @ model.discounts[0] / np.maximum(total, 1), 1.0)
    keys = _pair(before, word)
    pairs, first, pair_at = np.unique(keys, return_index=True, return_inverse=True)
    count = np.zeros(len(pairs), np.int64)
    for s, mine in by_shard(pairs, _pair_shard(before[first], pairs, model.hot, model.shards), model.shards):
        hit, at = found_in(pairs[mine], arrays.get(f"pair-{s}", np.uint64))
        held = arrays.get(f"count-{s}", np.uint8)[at].astype(np.int64)
        if (held == 255).any():
            place, large = arrays.get(f"over-{s}", np.int64).reshape(2, -1)
            big = held == 255
            held[big] = large[np.searchsorted(place, at[big])]
        count[mine[hit]] = held
    upper = np.maximum(count - discount(0, count), 0)[pair_at] / np.maximum(total, 1)[context_at]
    return np.log10(upper + back[context_at] * single[word_at]), seen[word_at, 0]


def score(rows: DataFrame, model: Model) -> DataFrame:
    """The rows without text, with n_tokens, n_known, train_tokens, base_score and score added; columns of these names are replaced."""
    added = [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]
    rows = rows.drop(*(name for name, _ in added))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.1 * (model.types + 1)
        for batch in batches:
            out = []
            for part in text.slices(batch):
                word, before, doc = _tokens(part)
                logs, count = _log_probs(model, word, before)
                docs = part.last - part.first
                n = np.bincount(doc, minlength=docs)
                base = np.log10((count + 0.1) / floor)
                out.append((n, np.bincount(doc, count > 0, docs), np.bincount(doc, base, docs), np.bincount(doc, logs, docs)))
            n, known, base, logs = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0)] * 4
            kept = [k for k, c in enumerate(batch.schema.names) if c != "text"]
            new = [n.astype(np.int64), known.astype(np.int64), np.full(len(n), model.tokens, np.int64), base, logs]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *map(pa.array, new)], names=[*(batch.schema.names[k] for k in kept), *(a for a, _ in added)]
            )

    schema = rows.drop("text").schema
    for name, kind in added:
        schema = schema.add(name, kind)
    return rows.mapInArrow(task, schema)
