"""Whole texts as byte buffers inside a task: slices of Arrow batches, words, 64-bit hashes.

Every operator reads documents through ``slices``: a null text is an empty one, texts are never cut, and a slice
holds whole documents of about ``SLICE`` bytes, or one longer document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SEED = 20_240_731
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Slice(NamedTuple):
    """Rows ``first`` to ``last`` of a batch: their bytes, the bounds of each text, and which were null."""

    first: int
    last: int
    raw: np.ndarray
    bounds: np.ndarray
    null: np.ndarray


@functools.lru_cache(maxsize=1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory of this worker goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_held: list[Callable] = []
_last: list[str] = []


def held(cache: Callable) -> Callable:
    """A cache that a worker keeps between the tasks of one operator, and drops when another operator's task comes."""
    _held.append(cache.cache_clear)
    return cache


def begin(operator: str) -> None:
    """A task of ``operator`` starts in this worker."""
    if _last != [operator]:
        for clear in _held:
            clear()
        _last[:] = [operator]
        give_back()


def returned(task: Callable) -> Callable:
    """The task of ``mapInArrow``, giving its freed memory back to the machine at its end: Python workers outlive tasks, and
    go from one operator's to another's."""
    operator = task.__module__

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        yield from task(batches)
        give_back()

    return whole


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[Slice]:
    texts = batch.column(column)
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    null = np.asarray(texts.is_null())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Slice(first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first], null[first:last])
        first = last


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and the document it is in; runs stop at text bounds."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACES[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(bounds, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any range of the bytes."""
    up, _ = _grown(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes in any task."""
    _, down = _grown(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hash_of(text: bytes) -> int:
    """The hash of one word, as ``span_hash`` gives it."""
    raw = np.frombuffer(text, np.uint8)
    return int(span_hash(prefix(raw), np.array([0]), np.array([len(raw)]))[0])


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def decoded(raw: np.ndarray, start: int, end: int) -> str:
    return raw[start:end].tobytes().decode("utf-8", "replace")
