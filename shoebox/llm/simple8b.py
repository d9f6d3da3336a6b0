"""Simple-8b coding of token ids in blocks: a 4-bit selector and up to 60 equal-width slots per 64-bit word.

A block holds ``BLOCK`` ids (the last of a file fewer). Rare large ids would force wide slots on their
neighbours, so a block has a cap of c bits: an id of 2^c - 1 or more is written as the slot value 2^c - 1, and
its 32 bits go to the block's escape list. A block's words, its escapes and its sizes stand behind per-block
offsets, so any run of blocks is decoded together by array operations. Ids are unsigned 32-bit integers.

Fixed values of the coding: (slots, bits) of selectors 1 to 14; selector 0 is a run of zeros, its length the payload.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 1024
SLOTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
CAPS = (8, 10, 12, 15, 33)
NO_CAP = 33
SHIFT = np.uint64(60)
_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


class Blocks(NamedTuple):
    """Coded blocks: words and escapes end to end, and per block the ids, words, escapes and the cap."""

    words: np.ndarray
    escapes: np.ndarray
    n_ids: np.ndarray
    n_words: np.ndarray
    n_escapes: np.ndarray
    cap: np.ndarray


def _lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    out = _LENGTHS[np.minimum(ids, len(_LENGTHS) - 1)]
    wide = np.flatnonzero(ids >= len(_LENGTHS))
    out[wide] = np.frexp(ids[wide].astype(np.float64))[1]
    return out


def _caps(lengths: np.ndarray, blocks: int) -> np.ndarray:
    """The cap of each block with the least estimated bits, from how many ids it has of each length."""
    block = np.repeat(np.arange(blocks), BLOCK)[: len(lengths)]
    many = np.bincount(block * 33 + lengths, minlength=33 * blocks).reshape(-1, 33)
    width = np.arange(33)
    cost = [many @ (np.array(BITS)[np.searchsorted(BITS, np.clip(width, 1, cap))] + 32 * (width > cap)) for cap in CAPS]
    return np.array(CAPS, np.uint8)[np.argmin(np.array(cost), axis=0)]


def _widest(bits: np.ndarray, known: dict[int, np.ndarray], size: int) -> np.ndarray:
    """For each place of a row the most bits among it and the next ``size - 1`` places; rows end in ``SLOTS[0]`` places of padding."""
    if size not in known:
        half = _widest(bits, known, (size + 1) // 2)
        out = half.copy()
        shift = size - (size + 1) // 2
        np.maximum(half[:, :-shift], half[:, shift:], out=out[:, :-shift])
        known[size] = out
    return known[size]


def encode(ids: np.ndarray) -> Blocks:
    n = len(ids)
    if not n:
        none = np.zeros(0, np.int64)
        return Blocks(np.zeros(0, np.uint64), np.zeros(0, np.uint32), none, none, none, np.zeros(0, np.uint8))
    first = np.arange(0, n, BLOCK)
    size = np.minimum(BLOCK, n - first)
    lengths = _lengths(ids)
    cap = _caps(lengths, len(first))
    marker = np.repeat((np.uint64(1) << cap.astype(np.uint64)) - np.uint64(1), size)
    over = ids >= marker
    held = np.where(over, marker, ids)
    bits = np.where(over, np.repeat(cap, size), lengths)
    # One row per block, padded by ids that fit everywhere: a word takes as many slots as all fit, or the rest of its block.
    rows = np.zeros((len(first), BLOCK + SLOTS[0]), np.uint8)
    padded = np.zeros(len(first) * BLOCK, np.uint8)
    padded[:n] = bits
    rows[:, :BLOCK] = padded.reshape(-1, BLOCK)
    selector, known = np.zeros((len(first), BLOCK), np.uint8), {1: rows}
    for k in reversed(range(len(SLOTS))):  # from wide slots to narrow ones, so the most ids per word stay
        np.copyto(selector, k + 1, where=_widest(rows, known, SLOTS[k])[:, :BLOCK] <= BITS[k])
    selector = selector.ravel()[:n]
    take = np.minimum(np.array((0, *SLOTS))[selector], np.repeat(first + size, size) - np.arange(n))
    if not known[SLOTS[0]][:, :BLOCK].all():  # zeros enough for a run of their own
        here = np.arange(n)
        zeros = np.minimum.accumulate(np.where(held == 0, n, here)[::-1])[::-1] - here
        zeros = np.minimum(zeros, np.repeat(first + size, size) - here)
        longer = zeros > take
        take[longer], selector[longer] = zeros[longer], 0
    # All blocks step from word to word together.
    at, stop, visited = first.copy(), first + size, []
    live = np.arange(len(first))
    while len(live):
        visited.append(at[live])
        at[live] += take[at[live]]
        live = live[at[live] < stop[live]]
    place = np.sort(np.concatenate(visited))
    chosen = selector[place]
    words = np.zeros(len(place), np.uint64)
    words[chosen == 0] = take[place[chosen == 0]].astype(np.uint64)
    for k in range(len(SLOTS)):
        mine = np.flatnonzero(chosen == k + 1)
        if len(mine):
            slot = np.arange(SLOTS[k])
            source = place[mine][:, None] + slot
            inside = slot < take[place[mine]][:, None]
            value = np.where(inside, held[np.where(inside, source, 0)], np.uint64(0))
            packed = np.bitwise_or.reduce(value << (slot * BITS[k]).astype(np.uint64), axis=1)
            words[mine] = packed | (np.uint64(k + 1) << SHIFT)
    n_words = np.diff(np.append(np.searchsorted(place, first), len(place)))
    return Blocks(words, ids[over].astype(np.uint32), size, n_words, np.add.reduceat(over.astype(np.int64), first), cap)


def decode(blocks: Blocks) -> np.ndarray:
    words = blocks.words
    if not len(words):
        return np.zeros(0, np.uint32)
    selector = (words >> SHIFT).astype(np.int64)
    payload = words & ((np.uint64(1) << SHIFT) - np.uint64(1))
    full = np.where(selector == 0, payload.astype(np.int64), np.array((0, *SLOTS))[selector])
    # The last word of a block may have empty slots.
    last = np.cumsum(blocks.n_words) - 1
    before = np.add.reduceat(full, np.append(0, last[:-1] + 1)) - full[last]
    full[last] = blocks.n_ids - before
    start = np.cumsum(full) - full
    out = np.zeros(int(full.sum()), np.uint64)
    for k in range(len(SLOTS)):
        mine = np.flatnonzero(selector == k + 1)
        if len(mine):
            # Words that end a block may have empty slots.
            whole = mine[full[mine] == SLOTS[k]]
            slot = np.arange(SLOTS[k])
            low, shift = np.uint64((1 << BITS[k]) - 1), (slot * BITS[k]).astype(np.uint64)
            out[start[whole][:, None] + slot] = (payload[whole][:, None] >> shift) & low
            for w in mine[full[mine] < SLOTS[k]]:
                out[start[w] : start[w] + full[w]] = (payload[w] >> shift[: full[w]]) & low
    marker = (np.uint64(1) << np.repeat(blocks.cap, blocks.n_ids).astype(np.uint64)) - np.uint64(1)
    out[out == marker] = blocks.escapes
    return out.astype(np.uint32)
