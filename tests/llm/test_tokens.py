"""Token ids, Simple-8b blocks, token files and packing against the tokenizer and plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoebox.llm import packing, simple8b, text, token_files, tokens
from tests.llm.helpers import TOKENIZER, awkward, corpus, empty, frames


LIBRARY = Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return lambda body: LIBRARY.encode(body or "", add_special_tokens=False).ids


def encoded(texts, limit=1 << 20):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out = []
    for part in text.slices(batch, limit=limit):
        ids, bounds = tokens.encode(part.raw, part.bounds, TOKENIZER)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b 　\u0085ab'sZé!.1日🙂|", max_size=40), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    assert encoded(texts, limit=30) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "word", "'s", "!", "é", "\u3000"]), max_size=14))
def test_added_tokens_are_one_id(parts):
    body = "".join(parts)
    assert encoded([body, body + "<|endoftext|>"]) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in (body, body + "<|endoftext|>")]


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    found = Tokenizer.from_file(path)
    texts = ["Some Words, in  lower\ncase", "", "<|startoftext|> a<|endoftext|>"]
    raw = "".join(texts).encode()
    bounds = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    ids, upto = tokens.encode(np.frombuffer(raw, np.uint8), bounds, path)
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [found.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_and_special_strings(plain):
    assert plain("<|endoftext|> a") == [50256, 257]
    texts = ["<|endoftext|> a", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "x" * 300 + "<|endoftext|>", "x" * 5000, "it's they'll\n's", None, "a b" * 3000]
    assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.just(0), st.integers(0, 60), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=3000)
)
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = simple8b.encode(ids)
    assert (simple8b.decode(blocks) == ids).all()
    assert blocks.n_ids.sum() == len(ids)


def test_simple8b_packs(plain):
    ids = np.array(plain("the rest of the words " * 2000), np.uint32)
    blocks = simple8b.encode(ids)
    assert 8 * len(blocks.words) + 4 * len(blocks.escapes) < 2.2 * len(ids)


def test_files_round_trip(spark, plain):
    rows = corpus() + awkward()
    files = token_files.write(frames(spark, rows), TOKENIZER, end_id=0, parts=3)
    found = token_files.read(spark, files, with_ids=True).collect()
    assert len(found) == len(rows)
    found = sorted(found, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at, want = 0, defaultdict(list)
    for doc_id, body, *_ in rows:
        want[doc_id].append([*plain(body), 0])
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids"] in want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert token_files.read(spark, token_files.write(empty(spark), TOKENIZER, end_id=0)).count() == 0


def check_packing(found, rows, plain, capacity):
    want = sorted((r[0] is None, r[0] or 0, len(plain(r[1])) + 1) for r in rows)
    by_doc = defaultdict(int)
    sequences = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = defaultdict(int)
    for none, doc_id, n in want:
        total[None if none else doc_id] += n
    assert by_doc == total
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, plain, monkeypatch):
    rows = corpus(200) + awkward()
    docs = frames(spark, rows)
    for part in (packing.PART, 40):  # one partition, and several that exchange documents
        monkeypatch.setattr(packing, "PART", part)
        cut = packing.pieces(docs, TOKENIZER, end_id=2, capacity=128)
        found = packing.pack(cut, 128).collect()
        n = check_packing(found, rows, plain, 128)
        lengths = np.array([r["length"] for r in found])
        bound = packing.lower_bound(lengths, 128)
        assert bound <= n <= bound * 1.03 + 2
    for r in found:
        if r["doc_id"] == 199:
            ids = [*plain(rows[199][1]), 2][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(packing.pieces(empty(spark), TOKENIZER, end_id=2, capacity=128), 128).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=7))
def test_bound_never_exceeds_the_best(sizes):
    def best(left, bins):
        if not left:
            return len(bins)
        found = len(sizes)
        for k in range(len(bins)):
            if bins[k] + left[0] <= 30:
                found = min(found, best(left[1:], bins[:k] + [bins[k] + left[0]] + bins[k + 1 :]))
        return min(found, best(left[1:], [*bins, left[0]]))

    least = best(sorted(sizes, reverse=True), [])
    bins, offsets, slack = packing.best_fit(np.array(sizes), 30)
    assert packing.lower_bound(np.array(sizes), 30) <= least <= len(slack)
    assert (np.bincount(bins, sizes) == 30 - slack).all()


def test_a_word_is_learned_once_whatever_sign_follows():
    words, signs = [f"{a}{b}" for a in ("bran", "Stol", "wick") for b in ("ash", "oten", "ém", "ux")], [",", ".", "!", "?)", ".'s", ";\"", "'s.", "<|"]
    body = " ".join(w + s for w in words for s in signs) + " x<|endoftext|>. it's.'re,'ll ,a a.b,c .d .e"
    raw = np.frombuffer(body.encode(), np.uint8)
    ids, _ = tokens.encode(raw, np.array([0, len(raw)]), TOKENIZER)
    assert ids.tolist() == tokens._tokenizer(TOKENIZER).encode(body, add_special_tokens=False).ids
    tokens._known.cache_clear()
    plain = " ".join(w + s for w in words for s in (",", ".", "!", "?)"))
    raw = np.frombuffer(plain.encode(), np.uint8)
    tokens.encode(raw, np.array([0, len(raw)]), TOKENIZER)
    # Words that end in an ASCII letter and stand first or after a space, and the signs; 48 pieces before.
    assert len(tokens._known(TOKENIZER, tokens.KNOWN_PIECES).place) <= len(words) + 1 + 4
