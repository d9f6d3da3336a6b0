"""Substring dedup by automata, collocations and ranked search against brute force, on corpora with awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import automaton_dedup, collocations, lexical_search, queries, text
from tests.llm.helpers import ascii_lower, awkward, corpus, empty, frames

SPACE = re.compile("[^\x20\x09-\x0d]+")
TOP = 2**63 - 1


def brute_words_removed(rows):
    first = {}
    for doc_id, body, *_ in rows:
        w = SPACE.findall(body or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, TOP), TOP if doc_id is None else doc_id)
    out = []
    for doc_id, body, *_ in rows:
        w = SPACE.findall(body or "")
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (TOP if doc_id is None else doc_id):
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def words_removed(docs):
    return Counter(tuple(r) for r in automaton_dedup.digest(docs, automaton_dedup.spans(docs)).collect())


def passages():
    """Documents that share stretches: whole, nested, overlapping, at both ends, with ties and other white space."""
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(12)]
    shared = [" ".join(random.choices(vocabulary, k=n)) for n in (12, 13, 14, 40, 300)]
    rows = []
    for k in range(120):
        parts = [" ".join(random.choices(vocabulary + [f"own{k}"], k=random.randint(0, 20))) for _ in range(4)]
        parts += random.choices(shared, k=random.randint(0, 3))
        random.shuffle(parts)
        rows.append((random.choice([k, k, k // 2, None]), random.choice([" ", "\n", "\t \r"]).join(parts), "en", "web", 0))
    return rows


def test_automaton_dedup(spark):
    rows = passages() + corpus(40) + [(r[0] + 1000 if r[0] else r[0], *r[1:]) for r in awkward()]
    assert words_removed(frames(spark, rows)) == brute_words_removed(rows)


def test_automaton_dedup_stretches_and_shards(spark, monkeypatch):
    monkeypatch.setattr(automaton_dedup, "STRETCH", 16)
    monkeypatch.setattr(automaton_dedup, "SHARD", 50)
    monkeypatch.setattr(automaton_dedup, "HOT_SHARE", 8)
    rows = passages()
    assert words_removed(frames(spark, rows)) == brute_words_removed(rows)


def test_automaton_dedup_empty(spark):
    assert words_removed(empty(spark)) == Counter()


def test_matching_statistics():
    random.seed(3)
    texts = [[random.randrange(4) for _ in range(random.randint(1, 60))] for _ in range(12)]
    automaton = automaton_dedup.SuffixAutomaton()
    for owner, sequence in enumerate(texts):
        automaton.add(sequence, owner)
    opened = automaton_dedup._Opened.__new__(automaton_dedup._Opened)
    opened.move, opened.to, opened.link, opened.length, opened.least = automaton.arrays()
    rows = np.array([[random.randrange(-1, 5) for _ in range(80)] for _ in range(40)] + [(texts[0] * 80)[:80]])
    got = opened.whole(rows, 4)
    for r, row in enumerate(rows):
        for t in range(80):
            window = list(row[max(t - 3, 0) : t + 1])
            owners = [o for o, s in enumerate(texts) if any(s[k : k + 4] == window for k in range(len(s) - 3))]
            assert got[r, t] == (min(owners) if len(window) == 4 and owners else automaton_dedup.NULL_ID)


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, body, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(body or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        long = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in long.items()):
                continue
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 50)])
def test_collocations(spark, least, top):
    random.seed(9)
    rows = corpus(60) + awkward()
    for k in range(80):
        body = "".join(random.choice(["New", "york", "New York", "times", "de", "ñu", "x"]) + random.choice([" ", " ", "\t", ". ", ",", "\n"]) for _ in range(120))
        rows.append((k, body, random.choice(["en", "de", "de", None, "und", ""]), "web", 0))
    got = collocations.collocations(frames(spark, rows), top=top, least=least).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, least, top)


def test_collocations_empty(spark):
    assert collocations.collocations(empty(spark)).collect() == []


def test_quicksort_partitions():
    random.seed(1)
    columns = np.array([[random.randrange(1, 6), random.choice([0, 1, 2, 3]), 0] for _ in range(500)]).T
    columns[2] = [random.randrange(4) if c else 0 for c in columns[1]]
    weight = np.array([random.randrange(1, 4) for _ in range(500)])
    want = Counter()
    for c, w in zip(columns.T.tolist(), weight.tolist(), strict=True):
        for k in range(1, 4):
            if all(c[:k]):
                want[tuple(c[:k])] += w
    got = {tuple(columns[:k, p].tolist()): int(f) for k, at, total in collocations.partitions(columns, weight, 9) for p, f in zip(at, total, strict=True)}
    assert got == {p: f for p, f in want.items() if f >= 9}


def brute_search(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    bags = [(i, Counter(term.findall(ascii_lower(body or "")))) for i, body, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked = defaultdict(set)
    for item, body in items:
        asked[item] |= set(term.findall(ascii_lower(body or "")))
    for item, terms in asked.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, k", [(12 << 20, 50), (4000, 7)])
def test_lexical_search(spark, monkeypatch, block, k):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 400)
    monkeypatch.setattr(lexical_search, "RANGE", 16 if block < 10000 else 128)
    rows = corpus(300) + awkward()
    random.seed(4)
    items = [(j, " ".join(random.choices(SPACE.findall(" ".join(r[1] or "" for r in rows[:50])), k=random.randint(1, 40)))) for j in range(12)]
    items += [(50, None), (51, ""), (52, "zzzz-nowhere"), (53, rows[3][1]), (53, rows[4][1]), (None, rows[5][1]), (54, rows[6][1]), (54, rows[6][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "'x' AS doc_id")
    got = lexical_search.search(lexical_search.index(frames(spark, rows)), asked, k).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, items, k)


def test_lexical_search_empty(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(empty(spark)), asked).collect() == []
    assert lexical_search.search(lexical_search.index(frames(spark, corpus(5))), asked.where("false")).collect() == []


@pytest.mark.parametrize("name", ["op11_automaton_dedup", "op12_collocations", "op13_lexical_search"])
def test_queries_have_twins(name):
    assert name in queries.QUERIES and name in queries.SQL


def test_a_shard_is_counted_in_little_memory(monkeypatch):
    """Peak beside the shard's own arrays: sorting all its suffixes at once took several times as much."""
    rng = np.random.default_rng(7)
    held, blobs, bodies = collocations._Buffer(), [], []
    for _ in range(6):
        bodies.append(" ".join(f"w{x}" for x in rng.zipf(1.2, 60_000) % 30_000))
        batch = pa.RecordBatch.from_pydict({"text": [bodies[-1]]})
        for part in text.slices(batch):
            held.add(part, ["en"])
        blobs += held.dealt(1).column("blob").to_pylist()
    shard = pa.table({"shard": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
    monkeypatch.setattr(collocations, "STRETCH", 1 << 14, raising=False)
    tracemalloc.start()
    found = collocations._counted(shard, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for body in bodies:
        words = body.split()
        for n in (1, 2, 3):
            want.update(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
    got = {r["phrase"]: r["f"] for r in found.to_pylist() if r["k"]}
    assert got == {p: f for p, f in want.items() if f >= 10}
    assert sum(r["f"] for r in found.to_pylist() if not r["k"]) == 360_000
    assert peak < 25_000_000  # 38 million before
