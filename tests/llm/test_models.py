"""Learned operators: Kneser-Ney against a model in plain Python, profiles, toxicity and site quality by held-out rows."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoebox.llm import kneser_ney, langid, quality_rules, queries, site_quality, toxicity
from tests.llm.helpers import ascii_lower, awkward, corpus, empty, frames, prose, words

START, END = object(), object()


def brute_kneser_ney(train, test):
    pairs, unigrams = Counter(), Counter()
    for body in train:
        seq = [*words(ascii_lower(body)), END]
        unigrams.update(seq)
        pairs.update(zip([START, *seq[:-1]], seq, strict=True))
    after = Counter(w for _, w in pairs)

    def discounts(counts):
        n = Counter(counts)
        return kneser_ney._discounts(n[1], n[2], n[3], n[4])

    upper, lower = discounts(pairs.values()), discounts(after.values())
    d = lambda table, c: 0 if not c else table[min(c, 3) - 1]
    context = defaultdict(list)
    for (v, _), c in pairs.items():
        context[v].append(c)
    rest = sum(d(lower, c) for c in after.values()) / len(pairs) if pairs else 1.0

    def p(w, v):
        single = max(after[w] - d(lower, after[w]), 0) / max(len(pairs), 1) + rest / (len(unigrams) + 1)
        held = context.get(v)
        if not held:
            return single
        back = sum(d(upper, c) for c in held) / sum(held)
        return max(pairs[v, w] - d(upper, pairs[v, w]), 0) / sum(held) + back * single

    n = sum(unigrams.values())
    out = []
    for body in test:
        seq = [*words(ascii_lower(body)), END]
        score = sum(math.log10(p(w, v)) for v, w in zip([START, *seq[:-1]], seq, strict=True))
        base = sum(math.log10((unigrams[w] + 0.1) / (n + 0.1 * (len(unigrams) + 1))) for w in seq)
        out.append((len(seq), sum(w in unigrams for w in seq), n, base, score))
    return out


@pytest.mark.parametrize("hot", [1024, 20])
def test_kneser_ney(spark, monkeypatch, hot):
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", hot)
    rows = corpus(80) + awkward()
    train, test = rows[:60] + awkward(), rows
    model = kneser_ney.fit(frames(spark, train), shards=3)
    found = kneser_ney.score(frames(spark, test).select("doc_id", "text").coalesce(1), model).collect()
    want = brute_kneser_ney([r[1] for r in train], [r[1] for r in test])
    assert len(found) == len(want)
    key = lambda x: tuple(round(v, 6) for v in x)
    got = sorted(key((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in found)
    assert np.allclose(np.array(got), np.array(sorted(map(key, want))), atol=1e-5)


def test_kneser_ney_sums_to_one(spark):
    train = [r[1] for r in corpus(30)]
    model = kneser_ney.fit(frames(spark, corpus(30)), shards=2)
    vocabulary = sorted({w for t in train for w in words(ascii_lower(t))})
    hashes = np.array([kneser_ney.text.hash_of(w.encode()) for w in vocabulary] + [int(kneser_ney.END), 12345], np.uint64)
    for before in (kneser_ney.START, hashes[0], hashes[3], np.uint64(999)):
        logs, _ = kneser_ney._log_probs(model, hashes, np.full(len(hashes), before, np.uint64))
        assert abs((10**logs).sum() - 1) < 1e-9


def test_kneser_ney_empty(spark):
    model = kneser_ney.fit(empty(spark))
    rows = kneser_ney.score(frames(spark, awkward()).select("doc_id", "text"), model).collect()
    assert len(rows) == len(awkward()) and all(r["n_known"] == 0 and r["score"] == 0 for r in rows)
    assert kneser_ney.score(empty(spark).select("doc_id", "text"), model).count() == 0


def test_language_by_held_out_rows(spark):
    rng = random.Random(3)
    stems = {"aa": ("an", "the", "er", "on"), "bb": ("qu", "eau", "oi", "é"), "cc": ("sch", "ung", "ein", "ö")}
    rows = [(k, prose(rng, 30, stems[lang]), lang, "s", 1) for k, lang in enumerate(sorted(stems) * 30)]
    profiles = langid.fit(frames(spark, rows[:45]))
    docs = frames(spark, [*rows[45:], *awkward(), (90, "!!! 12 %", "aa", "s", 1)])
    found = langid.predict(docs, profiles).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found if r["source"] == "s" and r["doc_id"] != 90)
    assert right == len(rows) - 45
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    none = langid.predict(docs, langid.fit(empty(spark))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == docs.count()
    assert langid.predict(empty(spark), profiles).count() == 0


def test_language_vectors_are_the_definition(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["Ab, ba", None, "ab"]})
    part = next(langid.text.slices(batch))
    found = langid._bundles(part, np.arange(4), 4, 64, 3)
    v = lambda c: langid._vector(ord(c), 64)
    gram = lambda s: np.roll(v(s[0]), 2) * np.roll(v(s[1]), 1) * v(s[2])
    assert (found[0] == gram(" ab") + gram("ab ") + gram(" ba") + gram("ba ")).all()
    assert not found[1].any()
    assert (found[2] == gram(" ab") + gram("ab ")).all()


def toxic_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        body = prose(rng, 40).split()
        for w in rng.sample(["scum", "idiot", "trash"], 2) if bad else ():
            body.insert(rng.randrange(len(body)), w)
        rows.append((k, " ".join(body), "en", "s", 1))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frames(spark, rows + awkward())
    index = toxicity.fit(docs.where("doc_id < 300"), table)
    found = {r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text"), index).collect()}
    wrong = sum((found[k]["score"] >= 0.7) != bool(t) for k, t in labels if k >= 300)
    assert wrong == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[300]["evidence"]
    assert toxicity.score(docs, index).count() == len(rows) + len(awkward())
    none = toxicity.fit(empty(spark), table)
    assert {r["score"] for r in toxicity.score(docs.select("doc_id", "text"), none).collect()} == {0.0}
    one_kind = toxicity.fit(docs, table.where("toxic = 1"))
    assert {r["score"] for r in toxicity.score(docs.select("doc_id", "text"), one_kind).collect()} == {1.0}
    assert toxicity.score(empty(spark), index).count() == 0


def test_nearest_is_exact(monkeypatch):
    """Against all cosines, on words with long and short lists; ties and a left-out example too."""
    monkeypatch.setattr(toxicity, "LONG", 12)
    rng = np.random.default_rng(1)
    matrix = (rng.random((500, 60)) * (rng.random((500, 60)) < np.linspace(0.02, 0.5, 60))).astype(np.float32)
    matrix[100:103] = matrix[7]
    matrix[5] = 0
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    doc, term = np.nonzero(matrix)
    lists = toxicity.built(np.arange(60, dtype=np.uint64), np.ones(60, np.float32), doc, term, matrix[doc, term], np.zeros(500), np.arange(500))
    queries = np.concatenate([matrix[::7], np.zeros((1, 60), np.float32)])
    qd, qt = np.nonzero(queries)
    full = np.round(queries @ matrix.T, 6)
    for skip in (None, rng.integers(0, 500, len(queries))):
        best, place = toxicity.nearest(lists, len(queries), qd, qt, queries[qd, qt], 10, skip)
        left = full.copy()
        if skip is not None:
            left[np.arange(len(queries)), skip] = 0
        want = -np.sort(-left, axis=1)[:, :10]
        assert np.allclose(best, np.where(want > 0, want, 0), atol=1e-5)
        assert np.allclose(np.take_along_axis(left, np.maximum(place, 0), 1)[place >= 0], best[place >= 0], atol=1e-5)
        assert (place[-1] == -1).all()
    few = toxicity.built(np.arange(60, dtype=np.uint64), np.ones(60, np.float32), doc[doc < 3], term[doc < 3], matrix[doc, term][doc < 3], np.zeros(3), np.arange(3))
    best, place = toxicity.nearest(few, len(queries), qd, qt, queries[qd, qt], 100)
    assert best.shape == (len(queries), 100) and (place[:, 3:] == -1).all() and np.allclose(np.sort(best[:, :3]), np.sort(np.maximum(full[:, :3], 0)), atol=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_toxicity_of_held_out_documents(spark):
    """On the query's own folds: nearly all pairs of a toxic and a clean document in order, evidence for every text with words."""
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = found.where("held_out and toxic is not null").groupBy("doc_id").agg({"score": "max", "toxic": "max", "evidence": "max"}).collect()
    score = np.array([r["max(score)"] for r in rows])
    toxic = np.array([r["max(toxic)"] for r in rows]) == 1
    order = np.sort(score[~toxic])
    auc = (np.searchsorted(order, score[toxic], "left") + np.searchsorted(order, score[toxic], "right")).mean() / 2 / len(order)
    assert auc >= 0.95
    assert (score[toxic] >= 0.7).mean() > 0.85 and (score[~toxic] >= 0.7).mean() < 0.02
    assert sum(not r["max(evidence)"] for r in rows) < 0.02 * len(rows)


def test_site_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        body = prose(rng, 30)
        rows.append((k, " ".join(w + "###" for w in body.split()) if bad else body, "en", f"h{k % 3}", 1))
        labels.append((k, int(not bad)))
    docs = frames(spark, rows + awkward()).selectExpr("doc_id", "text", "source as host", "lang as path")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    learned = table.where("doc_id % 2 = 0")
    found = site_quality.score(docs, learned, site_quality.fit(docs, learned)).collect()
    assert len(found) == len(rows) + len(awkward())
    # The awkward rows have ids 1 to 7 again; their rows aside.
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[k] == bool(q) for k, q in labels if k % 2 and k > 7)
    none = site_quality.score(docs, learned.where("false"), site_quality.fit(docs, learned.where("false"))).collect()
    assert len(none) == len(found) and all(0 <= r["score"] <= 1 for r in none)
    cold = docs.where("false")
    assert site_quality.score(cold, learned, site_quality.fit(cold, learned)).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", float(k % 10 != 0)) for k in range(500)] + [("bad", "p", float(k % 10 == 0)) for k in range(500)]
    rows += [("tiny", "p", 0.0), (None, None, 1.0)]
    found = {r["site" if "site" in r else "host"]: r for r in site_quality.posteriors(spark.createDataFrame(rows, "host string, path string, hit double")).collect()}
    assert found["big"]["host_rate"] > 0.85 and found["bad"]["host_rate"] < 0.15
    assert 0.2 < found["tiny"]["host_rate"] < 0.5
    assert 0.5 < found[None]["host_rate"] < 0.8


def brute_counts(body):
    found = words(body)
    windows = [tuple(found[k : k + 8]) for k in range(len(found) - 7)]
    many = Counter(windows)
    covered = {j for k, w in enumerate(windows) if many[w] > 1 for j in range(k, k + 8)}
    lines = [x for x in (body or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in body or "")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "WEIGHT", 20)
    rng = random.Random(4)
    rows = corpus(120) + awkward()
    rows += [(500, "a b c d e f g h " * 5, "en", "s0", 1), (501, " ".join(w + "#$" for w in prose(rng, 40).split()), "en", "s0", 1)]
    rows += [(502, prose(rng, 30) + " one two three four five six seven eight nine ten " + prose(rng, 30) + " one two three four five six seven eight nine ten", "en", "s0", 1)]
    found = quality_rules.judge(frames(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((r["doc_id"], *(r[n] for n in names)) for r in found if r["doc_id"] is not None)
    assert got == sorted(((r[0], *brute_counts(r[1])) for r in rows if r[0] is not None), key=key)
    assert len(found) == len(rows)
    verdict = {r["doc_id"]: r for r in found}
    assert verdict[500]["base_failed"] and not verdict[500]["kept"]
    assert verdict[501]["failed"] == ["symbol_share"]
    assert all(r["kept"] for r in found if r["n_words"] >= 20 and (r["doc_id"] or 0) < 120 and not r["base_failed"] and not r["failed"])
    # Every verdict against fences from counted bins.
    want = brute_verdicts([(r[0], r[1], r[2], r[3]) for r in rows], 20)
    assert Counter((r["doc_id"], r["kept"], tuple(r["failed"])) for r in found) == want
    assert sum(not kept for _, kept, _ in want) > 1
    again = quality_rules.judge(frames(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, ((r["doc_id"], r["kept"]) for r in again))) == Counter((r["doc_id"], r["kept"]) for r in found)
    assert quality_rules.judge(empty(spark)).count() == 0


def brute_verdicts(rows, weight):
    measured = []
    for doc_id, body, lang, source in rows:
        n, chars, symbols, dup, repeated = brute_counts(body)
        lines = len([x for x in (body or "").split("\n") if words(x)])
        share = lambda a, b: a / b if b else 0.0
        values = (share(symbols, chars), share(dup, lines), share(repeated, n), share(chars, n))
        measured.append((doc_id, lang, source, n, 100 * repeated > 30 * n, values))

    def bin_of(v):
        return 0 if v <= 1e-6 else 1 + math.floor(math.log(v / 1e-6) / math.log(1.01))

    def middle(b):
        return 0.0 if b == 0 else 1e-6 * 1.01 ** (b - 0.5)

    def fence(some, m):
        bins = sorted(bin_of(x[5][m]) for x in some)
        q1, q3 = (middle(bins[math.ceil(q * len(bins)) - 1]) for q in (0.25, 0.75))
        return q3 + (q3 - q1) * 3.0 + (0.02, 0.25, 0.10, 2.0)[m]

    out = Counter()
    for doc_id, lang, source, n, repeats, values in measured:
        failed = []
        for m, name in enumerate(quality_rules.MEASURES):
            own, its = [x for x in measured if x[1:3] == (lang, source)], [x for x in measured if x[1] == lang]
            above = (len(its) * fence(its, m) + weight * fence(measured, m)) / (len(its) + weight)
            if values[m] > (len(own) * fence(own, m) + weight * above) / (len(own) + weight):
                failed.append(name)
        out[doc_id, n >= 20 and not repeats and not failed, tuple(failed)] += 1
    return out


def test_folds_are_by_text_of_the_id(spark):
    from shoebox.llm.spark import crc_fold

    rows = spark.createDataFrame([(k,) for k in (0, 7, 123456, None)], "doc_id long").select("doc_id", crc_fold("doc_id", 10).alias("f")).collect()
    assert all(r["f"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 if r["doc_id"] is not None else 0) for r in rows)
