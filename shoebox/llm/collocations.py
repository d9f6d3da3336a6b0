"""Phrase collocations: multikey three-way quicksort of suffix pointers, counts being the sizes of equal partitions.

Every word of a text begins a suffix, cut at the end of its piece and at ``DEPTH`` words. A task writes each distinct suffix
of its buffer once, with its weight, so a frequent phrase costs one entry per buffer however often it stands in the text.
Suffixes are routed to shards by their two leading words, and once more as one word by that word: all suffixes that share
two words, or one, meet, and a frequent word's suffixes spread over the shards by what follows it.

A shard sorts pointers to its suffixes by three-way partitions, all open partitions at once: less than, equal to and greater than
the pivot word at the partition's depth. The equal part is a phrase one word longer, its weight the phrase's count, and goes on at the next
word; every part lighter than the least count is abandoned there and then, so only what can still hold a frequent phrase is sorted on.

Frequent phrases are short rows from there on. Scores come from exact decimals: each cut of a candidate looks up its two
parts, both at least as frequent as the candidate itself, so no abandoned phrase is missed.

A null or empty text has no word; a null language is ``und``, together with that one. Repeated rows and equal ids count each. Very long
texts are whole. Ties: equal scores and counts by the phrase's bytes. No rows, or no frequent phrase: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoebox.llm import text
from shoebox.llm.blobs import BLOBS, pack, unpack
from shoebox.llm.spark import lookup
from shoebox.session import durable

DEPTH = 3
LEAST = 10
INSIDE = 50  # percent of a candidate that lies in one longer phrase
UNKNOWN = "und"
WORD_BITS = 21
FLUSH = 1 << 20  # words a task holds, at most one slice more
SHARD_BYTES = 16 << 20  # of text per shard
STRETCH = 1 << 18  # suffixes of a shard that are sorted together, or those of one leading word
COUNTED = "lang string, k int, phrase string, f long"
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
FOLD = text.LOWER.copy()
FOLD[CUTS] = 0x20
FOLD[0x09] = 0x20


def _suffixes(part: text.Slice) -> tuple[np.ndarray, ...]:
    """Folded bytes; start, end and document of every word; whether the next word follows in the same piece."""
    raw = FOLD[part.raw]
    start, end, doc = text.words(raw, part.bounds)
    cuts = np.append(0, np.cumsum(CUTS[part.raw]))
    goes_on = np.zeros(len(start), bool)
    goes_on[:-1] = (doc[1:] == doc[:-1]) & (cuts[start[1:]] == cuts[end[:-1]])
    return raw, start, end, doc, goes_on


class _Buffer:
    """Words of a task until they are dealt."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.count = self.size = 0
        self.langs: dict[str, int] = {}

    def add(self, part: text.Slice, langs: list[str | None]) -> None:
        raw, start, end, doc, goes_on = _suffixes(part)
        code = np.array([self.langs.setdefault(UNKNOWN if x is None else x, len(self.langs)) for x in langs], np.int64)
        lang = code[doc]
        key = _keys(raw, start, end, lang, self.langs)
        self.parts.append((raw, key, start + self.size, end - start, lang, goes_on))
        self.count += len(start)
        self.size += len(raw)

    def dealt(self, shards: int) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*self.parts, strict=True)]
        self.parts = []
        raw, key, start, size, lang, goes_on = map(_joined, columns)
        known, first, word = np.unique(key, return_index=True, return_inverse=True)
        start, size, lang = start[first], size[first], lang[first]
        del key, first
        # The suffix at each word, as three word numbers from 1 in one integer; 0 is the end.
        word = word.astype(np.uint64) + np.uint64(1)
        second = np.where(goes_on, np.append(word[1:], 0), 0).astype(np.uint64)
        third = np.where(goes_on, np.append(second[1:], 0), 0).astype(np.uint64)
        bits = np.uint64(WORD_BITS)
        long, weight = np.unique(((word << bits | second) << bits | third)[second > 0], return_counts=True)
        single = np.bincount(word.astype(np.int64) - 1)
        del word, second, third, goes_on
        low = np.uint64((1 << WORD_BITS) - 1)
        alone = np.zeros(len(known), np.int32)
        columns = [
            np.concatenate([np.arange(1, len(known) + 1, dtype=np.int32), (long >> bits >> bits).astype(np.int32)]),
            np.concatenate([alone, (long >> bits & low).astype(np.int32)]),
            np.concatenate([alone, (long & low).astype(np.int32)]),
        ]
        weight = np.concatenate([single, weight]).astype(np.int32)
        del long, single
        lead = np.append(np.uint64(0), known)
        shard = (text.mix(lead[columns[0]] + text.mix(lead[columns[1]])) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        names = "\0".join(self.langs).encode()
        rows, blobs = [], []
        for s in range(shards):
            if cut[s] == cut[s + 1]:
                continue
            here = order[cut[s] : cut[s + 1]]
            # The shard's own numbers: words in order of language, then as found.
            used = np.unique(np.concatenate([c[here] for c in columns]))
            used = used[used > 0]
            used = used[np.argsort(lang[used - 1], kind="stable")]
            number = np.zeros(len(known) + 1, np.int32)
            number[used] = np.arange(1, len(used) + 1)
            at, length = start[used - 1], size[used - 1] + 1  # with the space that ends it
            letters = raw[np.minimum(np.repeat(at, length) + text.spread(length), len(raw) - 1)]
            letters[np.cumsum(length) - 1] = 0x20
            rows.append(s)
            blobs.append(pack(np.frombuffer(names, np.uint8), np.bincount(lang[used - 1], minlength=len(self.langs)), letters, *(number[c[here]] for c in columns), weight[here]))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _routed(docs: DataFrame, shards: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buffer()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in text.slices(batch):
                held.add(part, langs[part.first : part.last])
                if held.count >= FLUSH:
                    yield held.dealt(shards)
        if held.count:
            yield held.dealt(shards)

    return docs.mapInArrow(text.returned(task), BLOBS)


def partitions(columns: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of the pointers to ``columns[:, pointer]``, symbols from 1, 0 being the end.

    Yields depth, a pointer and the weight of the equal partitions of at least ``least``, many at a time. All open partitions
    take a step together; a partition lighter than ``least`` is abandoned.
    """
    depths, n = columns.shape
    random = np.random.default_rng(text.SEED)
    at, start, depth = np.arange(n), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while len(at):
        size = np.diff(start, append=len(at))
        enough = np.add.reduceat(weight[at], start, dtype=np.int64) >= least
        if not enough.all():
            at = at[np.repeat(enough, size)]
            size, depth = size[enough], depth[enough]
            start = np.cumsum(size) - size
            if not len(at):
                return
        part = np.repeat(np.arange(len(start)), size)
        symbol = columns[depth[part], at]
        pivot = symbol[start + (random.random(len(start)) * size).astype(np.int64)]  # sorted runs make a fixed place a bad one
        side = np.sign(symbol - pivot[part]) + 1
        # A stable deal of every partition into its three parts.
        sizes = np.bincount(part * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        begin = np.cumsum(sizes.ravel()).reshape(-1, 3) - sizes
        place = np.empty(len(at), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            owner = part[mine]
            rank = np.arange(len(mine)) - (np.cumsum(sizes[:, s]) - sizes[:, s])[owner]
            place[mine] = begin[owner, s] + rank
        moved = np.empty_like(at)
        moved[place] = at
        at = moved
        # Equal parts are phrases, unless their symbol is the end; they go on at the next symbol, if there is one.
        equal = begin[:, 1]
        total = np.add.reduceat(np.append(weight[at], 0), np.stack([equal, equal + sizes[:, 1]], 1).ravel(), dtype=np.int64)[::2]
        phrase = (pivot > 0) & (total >= least)
        for d in np.unique(depth[phrase]):
            these = phrase & (depth == d)
            yield int(d) + 1, at[equal[these]], total[these]
        onward = sizes > 0
        onward[:, 1] &= (pivot > 0) & (depth + 1 < depths)
        deeper = np.stack([depth, depth + 1, depth], 1)
        keep = np.repeat(onward.ravel(), sizes.ravel())
        at = at[keep]
        left = sizes[onward]
        start, depth = np.cumsum(left) - left, deeper[onward]


def _keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, langs: Iterable[str]) -> np.ndarray:
    """A hash of every word with its language."""
    salt = np.array([text.hash_of(x.encode()) if x else 0 for x in langs], np.uint64)
    return text.mix(text.mix(text.span_hash(text.prefix(raw), start, end)) + salt[lang])


def _spans(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of words that each end in a space."""
    end = np.flatnonzero(letters == 0x20)
    return np.append(0, end[:-1] + 1)[: len(end)], end


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """The arrays end to end; the list is emptied."""
    out = np.concatenate(arrays)
    arrays.clear()
    return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key the place of one, and the number of every key's kind, from 1."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32)
    return order[fresh], number


def _stretches(lead: np.ndarray, weight: np.ndarray, mine: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """The places of ``mine`` by ranges of leading words, about ``STRETCH`` at a time; words lighter than ``least`` are abandoned."""
    words = int(lead.max(initial=0)) + 1
    steps = [slice(k, k + STRETCH) for k in range(0, len(lead), STRETCH)]
    total, many = np.zeros(words), np.zeros(words, np.int64)
    for s in steps:
        total += np.bincount(lead[s], np.where(mine[s], weight[s], 0), words)
    kept = [np.flatnonzero(mine[s] & (total[lead[s]] >= least)).astype(np.int32) + np.int32(s.start) for s in steps]
    for s in kept:
        many += np.bincount(lead[s], minlength=words)
    kept = np.concatenate([np.zeros(0, np.int32), *kept])
    leads, upto = lead[kept], np.cumsum(many)
    low = 0
    while low < words:
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + STRETCH, "right")))
        here = kept[(leads >= low) & (leads < high)]
        if len(here):
            yield here
        low = high


def _counted(table: pa.Table, least: int) -> pa.Table:
    """The frequent phrases of a shard; phrase null: how many words of a language it has."""
    langs: dict[str, int] = {}
    keys, owners, raws, suffixes, weights = [], [], [], [], []
    for blob in table.column("blob"):
        names, share, letters, *suffix, weight = unpack(blob.as_py(), np.uint8, np.int64, np.uint8, np.int32, np.int32, np.int32, np.int32)
        names = names.tobytes().decode().split("\0")
        lang = np.repeat(np.arange(len(names)), share)
        start, end = _spans(letters)
        keys.append(_keys(letters, start, end, lang, names))
        owners.append(np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)[lang])
        raws.append(letters)
        suffixes.append(suffix)
        weights.append(weight)
    # One number per word of a language, from 1, over all blobs.
    cut = np.cumsum([0, *map(len, keys)])
    first, number = _numbered(_joined(keys))
    owner = np.append(np.int32(0), _joined(owners)[first])
    raw = _joined(raws)
    start, end = (x[first] for x in _spans(raw))
    del first
    # Blobs are let go one by one as their suffixes get the common numbers.
    suffix, weight, at = np.empty((DEPTH, sum(map(len, weights))), np.int32), _joined(weights), 0
    for k, (low, high) in enumerate(zip(cut, cut[1:], strict=False)):
        own = np.append(np.int32(0), number[low:high])
        size = len(suffixes[k][0])
        for d in range(DEPTH):
            suffix[d, at : at + size] = own[suffixes[k][d]]
        suffixes[k], at = None, at + size
    del number
    text.give_back()
    names = list(langs)
    single = suffix[1] == 0
    total = np.bincount(owner[suffix[0, single]], weight[single], minlength=len(names)).astype(np.int64)
    out = [(names[g], 0, None, int(total[g])) for g in np.flatnonzero(total)]
    for mine in (single, ~single):
        for here in _stretches(suffix[0], weight, mine, least):
            symbols = suffix[:, here]
            for k, at, count in partitions(symbols, weight[here], least):
                # One word is whole only among the one-word suffixes: the others were routed by two words.
                if (k == 1) != (mine is single):
                    continue
                for p, f in zip(at, count, strict=True):
                    chain = symbols[:k, p]
                    phrase = b" ".join(raw[start[w - 1] : end[w - 1]].tobytes() for w in chain)
                    out.append((names[owner[chain[0]]], k, phrase.decode("utf-8", "replace"), int(f)))
    text.give_back()
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    columns = zip(*out, strict=True) if out else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "k", "phrase", "f"])


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase and f of all phrases of 1 to ``DEPTH`` words with f >= ``least``; k = 0 and phrase null: a part of the language's words."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    return durable(_routed(rows, shards).groupBy("shard").applyInArrow(lambda t: _counted(t, least), COUNTED))


def _part(cuts: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase in ``column``; a part that many cuts share is no single task's work."""
    key = ["lang", column]
    asked = cuts.groupBy(*key).agg(F.count("*").alias("_rows"))
    return lookup(cuts, asked.join(known.select("lang", F.col("phrase").alias(column), F.col("f").alias(name)), key), key, "_rows")


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases. ``docs`` has lang and text."""
    found = counts(docs, least)
    words = found.where(F.col("k") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    known = found.where(F.col("k") > 0)
    long = known.where(F.col("k") > 1)
    # Every cut of every candidate, by its two parts.
    cuts = long.select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = durable(_part(_part(cuts, known, "first", "l"), known, "rest", "r"))
    a, both = F.col("a").cast("decimal(15,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    scored = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * a * a).withColumn("below", both)
    scored = scored.withColumn("score", F.expr("above div below")).drop("above", "below")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    # The most frequent longer phrase around each candidate: longer by one word is enough, as counts only fall with length.
    longer = long.where(F.col("k") == DEPTH).select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < INSIDE * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
