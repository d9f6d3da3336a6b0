"""Removal of repeated word sequences by matching statistics against suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id.

The reference is what those windows need and no more: every window that stands in several documents, once, where it
stands first. Two passes over hashes find it. The first one takes an anchor per window, the ``GRAM``-word sequence with the least
hash (equal windows have equal anchors at one place), and keeps the anchors of more than one document; the second one takes
the windows around those and finds, for each that more than one document has, the first document and the stretch of it.
A third pass cuts the texts: runs of windows that stand first here are reference passages, runs of windows that
stand first in one stretch of an earlier document are to be streamed past the automaton of that stretch.

Passages are dealt to shards of about ``SHARD`` words by document and stretch. A shard's passages become one suffix automaton over words,
each state with the least document that its strings end in; it is written to the shared folder as one file. So automata are of
bounded size and broadcast by file: any task opens the ones its rows ask for. A shard that many documents repeat (a licence
line) is asked for by as many tasks as its rows need. Streaming keeps, word by word, the longest match that ends here, up to a window: at
a whole window the state tells the least document that has it. Maximal spans come from the union of the windows found.

Hashes only choose what is compared; words are compared as bytes, so a clash costs time and removes nothing.

Ids: nulls count as last and never remove from each other; rows with one id do not remove from each other, but others' copies from
both. A null or empty text has no words. Ties inside a document do not count. Texts are whole, however long, and a long one's
passages are dealt by stretches of ``STRETCH`` windows. Repeated rows get equal results. No rows: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import text
from shoebox.llm.blobs import BLOBS, arrays_of, by_shard, dealt, found_in, save, unpack
from shoebox.llm.spark import fresh_folder, open_folder
from shoebox.session import durable

WINDOW = 13
GRAM = 7
STRETCH = 1 << 16
SHARD = 1 << 17  # reference words of an automaton
FLUSH = 24 << 20  # bytes of text whose hashes a task holds
CHUNK = 256  # windows that are streamed in one row of a matrix
HOT_SHARE = 1024
NULL_ID = np.iinfo(np.int64).max
PLACE_BITS = np.uint64(28)
_POWERS = np.random.default_rng(text.SEED).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RUNS = "reference boolean, owner long, stretch int, doc_id long, body long, start long, words int, passage binary"
SPANS = "doc_id long, body long, spans array<bigint>"


def _sequences(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(word) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out += word[j : j + n] * _POWERS[j]
    return text.mix(out)


class _Windows:
    """The windows of a slice: where words are, which windows lie in one document, the anchor of each."""

    def __init__(self, part: text.Slice):
        self.start, self.end, self.doc = text.words(part.raw, part.bounds)
        self.word = text.span_hash(text.prefix(part.raw), self.start, self.end)
        n = len(self.word) - WINDOW + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.first_word = np.searchsorted(self.start, part.bounds[:-1])
        if not len(self.at):
            self.anchor = self.anchors = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = _sequences(self.word, GRAM)
        least = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 3):  # minima of 2, 4 and 7 neighbours
            least = np.minimum(least[:-step], least[step:])
        place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)[self.at]
        # Distinct anchors, the key of each, and the anchor of each window.
        fresh = np.append(True, place[1:] != place[:-1])
        self.anchors = place[fresh]
        self.anchor = np.cumsum(fresh) - 1
        self.key = grams[self.anchors] >> np.uint64(16)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


class _Files:
    """Sorted arrays per shard in the shared folder; a file that should be there and is not is an error."""

    def __init__(self, folder: str, names: dict[int, tuple[str, int]], shards: int, kinds: tuple):
        self.folder, self.names, self.shards, self.kinds = folder, names, shards, kinds

    def arrays(self, shard: int) -> list[np.ndarray]:
        name, size = self.names.get(shard, ("", 0))
        out = [arrays_of(self.folder).get(f"{name}-{k}", kind) if size else np.zeros(0, kind) for k, kind in enumerate(self.kinds)]
        if any(len(a) != size for a in out):
            raise FileNotFoundError(f"{self.folder}/{name}: {size} entries expected")
        return out

    def find(self, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are there, and their values, aligned with the keys."""
        hit = np.zeros(len(key), bool)
        values = [np.zeros(len(key), kind) for kind in self.kinds[1:]]
        for s, at in by_shard(key, _shard(key, self.shards), self.shards):
            known, *columns = self.arrays(s)
            yes, place = found_in(key[at], known)
            hit[at] = yes
            for value, column in zip(values, columns, strict=True):
                value[at[yes]] = column[place]
        return hit, values


def _saved(blobs: DataFrame, merged, shards: int, kinds: tuple) -> _Files:
    """Merge each shard's blobs to sorted arrays and keep them as files. A task that runs twice writes other names; one of them counts."""
    spark = blobs.sparkSession
    folder = fresh_folder(spark, "windows", make=True)

    def task(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        arrays = merged(table.column("blob").to_pylist())
        name = f"{shard}-{np.random.default_rng().integers(2**62):x}"
        for k, array in enumerate(arrays):
            save(folder, f"{name}-{k}", array)
        text.give_back()
        return pa.table({"shard": [shard], "name": [name], "size": pa.array([len(arrays[0])], pa.int64())}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("size", pa.int64())]))

    rows = blobs.groupBy("shard").applyInArrow(task, "shard int, name string, size long").collect()
    return _Files(folder, {r["shard"]: (r["name"], r["size"]) for r in rows}, shards, kinds)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _repeated(rows: DataFrame, shards: int) -> _Files:
    """The anchors of more than one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen = 0, 0

        def flush():
            row, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first) if len(first) else np.zeros(0, bool)
            key = key[first]
            return dealt(_shard(key, shards), shards, (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16), several)

        for batch in batches:
            for part in text.slices(batch):
                w = _Windows(part)
                held.append((seen + part.first + w.doc[w.anchors], w.key))
                size += len(part.raw)
                if size >= FLUSH:
                    yield flush()
                    size = 0
            seen += batch.num_rows
        if held:
            yield flush()

    def merged(blobs: list[bytes]) -> list[np.ndarray]:
        parts = [unpack(b, np.uint32, np.uint16, bool) for b in blobs]
        high, low, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = high.astype(np.uint64) << np.uint64(16) | low
        order = np.argsort(key, kind="stable")
        key, several = key[order], several[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        twice = np.diff(first, append=len(key)) > 1  # in two flushes, so in two rows
        return [key[first][twice | np.logical_or.reduceat(several, first)]]

    return _saved(rows.select("text").mapInArrow(text.returned(task), BLOBS), merged, shards, (np.uint64,))


def _candidates(w: _Windows, anchors: _Files) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the windows whose anchor stands in more than one document."""
    if not len(w.at):
        return w.at, np.zeros(0, np.uint64)
    hit, _ = anchors.find(w.key)
    at = w.at[hit[w.anchor]]
    return at, _sequences(w.word, WINDOW)[at]


def _firsts(key: np.ndarray, doc: np.ndarray, stretch: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per key: its least document and stretch, and whether it has another document."""
    order = np.lexsort((stretch, doc, key))
    key, doc, stretch, several = key[order], doc[order], stretch[order], several[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(first):
        return key, doc, stretch, several
    last = np.append(first[1:], len(key)) - 1
    return key[first], doc[first], stretch[first], np.logical_or.reduceat(several, first) | (doc[first] != doc[last])


def _first_windows(rows: DataFrame, anchors: _Files, shards: int) -> _Files:
    """The windows of more than one document, with the first document and the stretch of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, doc, stretch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, doc, stretch, several = _firsts(key, doc, stretch, np.zeros(len(key), bool))
            return dealt(_shard(key, shards), shards, key, doc, stretch, several)

        for batch in batches:
            ids = _ids(batch)
            for part in text.slices(batch):
                w = _Windows(part)
                at, key = _candidates(w, anchors)
                doc = w.doc[at]
                held.append((key, ids[part.first + doc], ((at - w.first_word[doc]) // STRETCH).astype(np.int32)))
                size += len(part.raw)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merged(blobs: list[bytes]) -> list[np.ndarray]:
        parts = [unpack(b, np.uint64, np.int64, np.int32, bool) for b in blobs]
        key, doc, stretch, several = _firsts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return [key[several], doc[several], stretch[several]]

    return _saved(rows.select("doc_id", "text").mapInArrow(text.returned(task), BLOBS), merged, shards, (np.uint64, np.int64, np.int32))


def _runs(rows: DataFrame, anchors: _Files, firsts: _Files) -> DataFrame:
    """Reference passages and the runs to stream, each with the document and stretch whose automaton it belongs to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = _ids(batch), batch.column("body").to_numpy(zero_copy_only=False)
            for part in text.slices(batch):
                w = _Windows(part)
                at, key = _candidates(w, anchors)
                hit, (owner, stretch) = firsts.find(key)
                at, owner, stretch = at[hit], owner[hit], stretch[hit]
                doc = w.doc[at]
                mine, here = ids[part.first + doc], at - w.first_word[doc]
                use = (owner < mine) | ((owner == mine) & (stretch == here // STRETCH))
                at, owner, stretch, doc, mine, here = (x[use] for x in (at, owner, stretch, doc, mine, here))
                if not len(at):
                    continue
                cut = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])
                low = np.flatnonzero(np.append(True, cut))
                high = np.append(low[1:], len(at)) - 1
                begin, stop = w.start[at[low]], w.end[at[high] + WINDOW - 1]
                data = memoryview(part.raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owner[low] == mine[low]), pa.array(owner[low]), pa.array(stretch[low]), pa.array(mine[low]),
                        pa.array(bodies[part.first + doc[low]]), pa.array(here[low]), pa.array((at[high] - at[low] + WINDOW).astype(np.int32)),
                        pa.array([bytes(data[a:b]) for a, b in zip(begin, stop, strict=True)], pa.binary()),
                    ],
                    names=["reference", "owner", "stretch", "doc_id", "body", "start", "words", "passage"],
                )

    return durable(rows.select("doc_id", "body", "text").mapInArrow(text.returned(task), RUNS))


class SuffixAutomaton:
    """A suffix automaton of word sequences, each state with the least owner of its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NULL_ID]

    def add(self, sequence: list[int], owner: int) -> None:
        following, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in sequence:
            if c in following[last]:
                q = following[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new = len(following)
                following.append({})
                length.append(length[last] + 1)
                least.append(NULL_ID)
                link.append(0)
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            if owner < least[last]:
                least[last] = owner

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.least.append(NULL_ID)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def arrays(self) -> list[np.ndarray]:
        """Sorted moves (state, word) and where they lead; link, length and least owner of every state."""
        link, length = np.array(self.link, np.int64), np.array(self.length, np.int64)
        least = np.array(self.least, np.int64)
        # A state's strings are suffixes of those of the states that link to it: longest states first.
        order = np.argsort(-length, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(length[order]) != 0))
        for low, high in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
            level = order[low:high]
            level = level[link[level] >= 0]
            np.minimum.at(least, link[level], least[level])
        sizes = np.fromiter(map(len, self.next), np.int64, len(self.next))
        word = np.fromiter((c for n in self.next for c in n), np.int64, int(sizes.sum()))
        to = np.fromiter((q for n in self.next for q in n.values()), np.int32, int(sizes.sum()))
        move = np.repeat(np.arange(len(sizes)), sizes) << 32 | word
        order = np.argsort(move, kind="stable")
        return [move[order], to[order], np.maximum(link, 0).astype(np.int32), length.astype(np.int32), least]


KINDS = (np.uint8, np.int64, np.int32, np.int32, np.int32, np.int64)


def _automaton(passages: list[bytes], owners: list[int]) -> list[np.ndarray]:
    """Vocabulary and arrays of the automaton of a shard."""
    words: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    for passage, owner in zip(passages, owners, strict=True):
        automaton.add([words.setdefault(w, len(words)) for w in passage.split()], owner)
    return [np.frombuffer(b" ".join(words), np.uint8), *automaton.arrays()]


def _written(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """All arrays in one file, moved into place whole; a file of an earlier attempt is as good."""
    fs, base = open_folder(folder)
    draft = f"{base}/_{name}-{np.random.default_rng().integers(2**62):x}"
    with fs.open_output_stream(draft) as out:
        out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
    if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
        fs.move(draft, f"{base}/{name}")
    else:
        fs.delete_file(draft)


class _Opened:
    """An automaton read from its file."""

    def __init__(self, folder: str, name: str):
        fs, base = open_folder(folder)
        with fs.open_input_stream(f"{base}/{name}") as source:
            sizes = np.frombuffer(source.read(8 * len(KINDS)), np.int64)
            arrays = [np.frombuffer(source.read(int(n) * np.dtype(k).itemsize), k) for n, k in zip(sizes, KINDS, strict=True)]
        letters, self.move, self.to, self.link, self.length, self.least = arrays
        self.words = {w: k for k, w in enumerate(letters.tobytes().split())}

    def whole(self, symbols: np.ndarray, limit: int = WINDOW) -> np.ndarray:
        """Matching statistics of the rows of ``symbols``, up to ``limit`` words: where a match of ``limit`` words ends, the least
        owner of that window, elsewhere NULL_ID. A symbol below 0 matches nothing."""
        rows, columns = symbols.shape
        state, match = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        out = np.full((rows, columns), NULL_ID)
        for t in range(columns):
            c = symbols[:, t]
            todo = np.flatnonzero(c >= 0)
            state[c < 0] = match[c < 0] = 0
            while len(todo):
                key = state[todo] << 32 | c[todo]
                at = np.minimum(np.searchsorted(self.move, key), len(self.move) - 1)
                yes = self.move[at] == key
                on = todo[yes]
                state[on] = self.to[at[yes]]
                match[on] += 1
                stuck = todo[~yes]
                match[stuck[state[stuck] == 0]] = 0
                todo = stuck[state[stuck] > 0]
                state[todo] = self.link[state[todo]]
                match[todo] = self.length[state[todo]]
            # No more than ``limit`` words are kept: up to the state whose strings of that length these are.
            long = np.flatnonzero(match >= limit)
            match[long] = limit
            up = long
            while len(up):
                up = up[self.length[self.link[state[up]]] >= limit]
                state[up] = self.link[state[up]]
            out[long, t] = self.least[state[long]]
        return out


@functools.lru_cache(maxsize=1)
def _opened(folder: str, name: str) -> _Opened:
    return _Opened(folder, name)


def _streamed(automaton: _Opened, passages: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each passage the places of its windows that stand in a document with a smaller id."""
    get = automaton.words.get
    symbols = [np.array([get(w, -1) for w in p.split()], np.int64) for p in passages]
    windows = np.array([max(len(s) - WINDOW + 1, 0) for s in symbols])
    chunks = -(-windows // CHUNK)
    owner = np.repeat(np.arange(len(symbols)), chunks)
    first = text.spread(chunks) * CHUNK
    width = min(CHUNK, int(windows.max(initial=0))) + WINDOW - 1
    matrix = np.full((len(owner), width), -1, np.int64)
    for r, (k, low) in enumerate(zip(owner, first, strict=True)):
        some = symbols[k][low : low + width]
        matrix[r, : len(some)] = some
    least = automaton.whole(matrix)[:, WINDOW - 1 :]
    row, place = np.nonzero(least < ids[owner][:, None])
    cut = np.searchsorted(owner[row], np.arange(len(symbols) + 1))
    place = place + first[row]
    return [place[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _ranges(places: np.ndarray) -> list[int]:
    """The words that windows at these places cover, as start, end, start, ..."""
    if not len(places):
        return []
    cut = np.flatnonzero(places[1:] > places[:-1] + WINDOW)
    low = places[np.append(0, cut + 1)]
    high = places[np.append(cut, len(places) - 1)] + WINDOW
    return np.stack([low, high], 1).ravel().tolist()


def _found(runs: DataFrame) -> DataFrame:
    """doc_id, body and word ranges of every run, by the automata of their shards."""
    spark = runs.sparkSession
    folder = fresh_folder(spark, "automata", make=True)
    total = runs.where("reference").agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("owner", "stretch"), F.lit(shards)))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        arrays = _automaton(table.column("passage").to_pylist(), table.column("owner").to_pylist())
        _written(folder, f"{shard}", arrays)
        text.give_back()
        return pa.table({"shard": pa.array([shard], pa.int64()), "states": pa.array([len(arrays[3])], pa.int64())})

    reference = runs.where("reference").select("shard", "owner", "start", "passage").dropDuplicates()
    durable(reference.groupBy("shard").applyInArrow(build, "shard long, states long"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard))
            ids, start = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy()
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(low, high - low)
                places = _streamed(_opened(folder, f"{shard[low]}"), part.column("passage").to_pylist(), ids[low:high])
                spans = [_ranges(p + s) for p, s in zip(places, start[low:high], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "body", "spans"])
        _opened.cache_clear()

    asked = runs.where(~F.col("reference"))
    # A shard with more than 1/HOT_SHARE of all words to stream goes to several tasks; there are fewer than HOT_SHARE such shards.
    load = asked.groupBy("shard").agg(F.sum("words").alias("load"))
    whole = asked.agg(F.sum("words")).first()[0] or 0
    share = max(1, whole // HOT_SHARE)
    pieces = load.where(F.col("load") > share).select("shard", F.ceil(F.col("load") / share).cast("int").alias("pieces"))
    dealt_out = asked.join(F.broadcast(pieces), "shard", "left").withColumn("piece", F.pmod(F.xxhash64("doc_id", "body", "start"), F.coalesce("pieces", F.lit(1))))
    dealt_out = dealt_out.repartition("shard", "piece").sortWithinPartitions("shard").select("shard", "doc_id", "body", "start", "passage")
    return durable(dealt_out.mapInArrow(text.returned(stream), SPANS))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text) and the word ranges to remove, as start, end, start, ... in no order, for documents that lose words.

    ``docs`` has doc_id and text. A null id reads as the largest long here.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("body", F.xxhash64("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = _repeated(rows, shards)
    found = _found(_runs(rows, anchors, _first_windows(rows, anchors, shards)))
    return found.where(F.size("spans") > 0).groupBy("doc_id", "body").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _left(words: list[bytes], gone: list[int]) -> list[bytes]:
    """The words outside the ranges."""
    out, at = [], 0
    for low, high in sorted(zip(gone[::2], gone[1::2], strict=True)):
        if low > at:
            out += words[at:low]
        at = max(at, high)
    return out + words[at:]


def digest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all rows of ``docs``, by the spans of ``found``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone").to_pylist()
            count, removed, kept = [], [], []
            for part in text.slices(batch):
                data = part.raw.tobytes()
                for k in range(part.last - part.first):
                    words = data[part.bounds[k] : part.bounds[k + 1]].split()
                    left = _left(words, gone[part.first + k] or [])
                    count.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    right = found.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("spans").alias("gone"))
    same = (F.coalesce("doc_id", F.lit(int(NULL_ID))) == F.col("_id")) & (F.xxhash64("text") == F.col("_body"))
    joined = rows.join(right.hint("shuffle_hash"), same, "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(text.returned(task), "doc_id long, n_words long, n_removed long, kept_sha256 string")
