"""Token ids of whole texts by a public tokenizer file, each distinct piece of text encoded once per worker.

The byte-level pre-tokenizer never joins text across an ASCII space or newline that stands alone between two
other characters: the space opens the next token, the newline is one of its own. Cutting there leaves the ids as
they are, and so does cutting between an ASCII letter and a sign other than the apostrophe. A piece (a word with its space, or
the signs behind it, mostly) is encoded when first met and looked up afterwards. An added token that stands
in a text is one id, as the library has it; it holds neither white space nor a sign that is cut at, so it stays in one piece.
Other kinds of tokenizer take whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np

from shoebox.llm import text

# A space, Latin letters, then signs without the apostrophe: two pre-tokens, whatever stands around them.
_PLAIN = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
KNOWN_PIECES = 400_000  # a worker forgets its pieces beyond this many, some 50 MB; rare ones seldom come back
LONG_PIECE = 256  # longer pieces are encoded where they stand


@text.held
@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _cuttable(path: str) -> bool:
    """Whether a text may be cut as above: byte-level merges alone, and added tokens that hold no white space and take none."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    before, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = made.get("added_tokens", [])
    closed = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or set(t["content"]) & set(" \n") for t in added)
    signs = all(_PLAIN.fullmatch(t["content"].encode()) is None for t in added)  # else a plain piece could be one
    return bool(plain and merges and closed and signs and not made.get("normalizer"))


@functools.lru_cache(maxsize=1)
def _byte_letters() -> str:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


def _encoded(path: str, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece: plain ones by the vocabulary's merges alone, the others through the whole tokenizer."""
    letters, merges = _byte_letters(), _tokenizer(path).model.tokenize
    out: list = [None] * len(pieces)
    rest = []
    for k, piece in enumerate(pieces):
        found = _PLAIN.fullmatch(piece)
        if found is None:
            rest.append(k)
            continue
        word, signs = found.groups()
        ids = [t.id for t in merges(word.decode("latin-1").translate(letters))]
        if signs:
            ids += [t.id for t in merges(signs.decode("latin-1"))]
        out[k] = ids
    batch = [pieces[k].decode("utf-8", "replace") for k in rest]
    for k, e in zip(rest, _tokenizer(path).encode_batch(batch, add_special_tokens=False), strict=True):
        out[k] = e.ids
    return out


def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
    return array if used + more <= len(array) else np.concatenate([array, np.zeros(max(len(array), more), array.dtype)])


class _Known:
    """Ids of the pieces met so far, end to end in one growing array."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit, self.place, self.used = path, limit, {}, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def numbers(self, pieces: list[bytes]) -> list[int]:
        if len(self.place) > self.limit:
            self.__init__(self.path, self.limit)
        place = self.place
        found = list(map(place.get, pieces))
        new = [k for k, n in enumerate(found) if n is None]
        if new:
            self._learn([pieces[k] for k in new])
            for k in new:
                found[k] = place[pieces[k]]
        return found

    def _learn(self, pieces: list[bytes]) -> None:
        ids = _encoded(self.path, pieces)
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        n = len(self.place)
        self.ids = _grown(self.ids, self.used, len(flat))
        self.start, self.count = _grown(self.start, n, len(ids)), _grown(self.count, n, len(ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(ids)] = self.used + np.cumsum(count) - count
        self.count[n : n + len(ids)] = count
        self.used += len(flat)
        self.place.update(zip(pieces, range(n, n + len(ids)), strict=True))


_known = text.held(functools.lru_cache(maxsize=2)(_Known))


_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may open a token with the letters behind it


@functools.lru_cache(maxsize=2)
def _closing(path: str) -> np.ndarray:
    """The signs before which a word of letters ends in any text: all that no added token holds."""
    with open(path, encoding="utf-8") as file:
        added = "".join(t["content"] for t in json.load(file).get("added_tokens", []))
    out = np.zeros(256, bool)
    out[[c for c in _SIGNS if chr(c) not in added]] = True
    return out


def _cuts(raw: np.ndarray, bounds: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Sorted positions, 0 and the end included, at which the bytes can be encoded apart."""
    n = len(raw)
    plain = (raw > 0x20) & (raw != 0x7F)
    before = np.zeros(n, bool)  # the character before is surely no white space
    before[1:] = plain[:-1]
    # Wider white space starts with C2 (two bytes) or E1 to E3 (three bytes).
    before[2:] &= raw[:-2] != 0xC2
    before[3:] &= (raw[:-3] < 0xE1) | (raw[:-3] > 0xE3)
    after = np.zeros(n, bool)
    after[:-1] = plain[1:] & (raw[1:] != 0xC2) & ((raw[1:] < 0xE1) | (raw[1:] > 0xE3))
    alone = before & after
    cut = alone & ((raw == 0x20) | (raw == 0x0A))
    cut[1:] |= (alone & (raw == 0x0A))[:-1]
    letter = ((raw | 0x20) - np.uint8(ord("a"))) < 26
    after_word = 1 + np.flatnonzero(letter[:-1] & ~letter[1:] & plain[1:])
    cut[after_word] |= closing[raw[after_word]]
    cut[bounds[:-1][bounds[:-1] < n]] = True
    cut[0] = True
    return np.append(np.flatnonzero(cut), n)


def encode(raw: np.ndarray, bounds: np.ndarray, path: str, limit: int = KNOWN_PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, end to end, and the bounds of each text's ids."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
    if not _cuttable(path):
        texts = [text.decoded(raw, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        whole = [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(whole), np.append(0, np.cumsum([len(x) for x in whole]))
    cuts = _cuts(raw, bounds, _closing(path))
    start, end = cuts[:-1], cuts[1:]
    key = text.span_hash(text.prefix(raw), start, end)
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    rep = first[same]
    # The hash only proposes that two pieces are equal; the bytes decide, and a clash is encoded on its own.
    size = end - start
    place = np.int32 if len(raw) < 1 << 30 else np.int64
    other = np.repeat((start[rep] - start).astype(place), size)
    other += np.arange(len(raw), dtype=place)
    odd = size != size[rep]
    differs = raw != raw[np.minimum(other, len(raw) - 1, out=other)]
    if differs.any():
        odd |= np.add.reduceat(differs, start) > 0
    extra = np.flatnonzero(odd)
    same[extra] = len(first) + np.arange(len(extra))
    data, each = raw.tobytes(), np.concatenate([first, extra])
    pieces = [data[a:b] for a, b in zip(start[each].tolist(), end[each].tolist(), strict=True)]
    known = _known(path, limit)
    lengths = np.concatenate([size[first], size[extra]])
    short, long = np.flatnonzero(lengths <= LONG_PIECE), np.flatnonzero(lengths > LONG_PIECE)
    number = np.zeros(len(pieces), np.int64)
    number[short] = known.numbers([pieces[k] for k in short.tolist()])
    starts, counts, pool = known.start, known.count, known.ids
    if len(long):
        own = _encoded(path, [pieces[k] for k in long.tolist()])
        more = np.array([len(x) for x in own])
        n = len(known.place)
        number[long] = n + np.arange(len(long))
        starts = np.append(starts[:n], known.used + np.cumsum(more) - more)
        counts = np.append(counts[:n], more)
        pool = np.concatenate([pool[: known.used], *(np.array(x, np.uint32) for x in own)])
    place = number[same]
    many = counts[place]
    ids = pool[np.repeat(starts[place], many) + text.spread(many)]
    upto = np.append(0, np.cumsum(many))
    return ids, upto[np.searchsorted(start, bounds, "left")]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new bounds."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
