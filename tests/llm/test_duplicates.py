"""Suffix dedup, SimHash, decontamination and the pipeline against brute force and planted rows."""

import hashlib
import random
from collections import Counter

import public_tokenizers  # noqa: F401
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from shoebox.llm import decontam, simhash, suffix_dedup, text
from tests.llm.helpers import ascii_lower, awkward, corpus, empty, frames, prose, words


def brute_removed(rows, length=50):
    first = {}
    top = 2**63 - 1
    for doc_id, body, *_ in rows:
        b = (body or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, top), top if doc_id is None else doc_id)
    out = []
    for doc_id, body, *_ in rows:
        b = (body or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (top if doc_id is None else doc_id):
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(spark, rows):
    docs = frames(spark, rows)
    found = suffix_dedup.digest(suffix_dedup.with_spans(docs, suffix_dedup.spans(docs))).collect()
    return Counter(tuple(r) for r in found)


def test_suffix_dedup(spark):
    rows = corpus(60) + [(r[0] + 100 if r[0] else r[0], *r[1:]) for r in awkward() if not r[1] or len(r[1]) < 5000]
    assert removed(spark, rows) == brute_removed(rows)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_few_symbols(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = []
    for k in range(25):
        a = rng.randrange(300)
        body = "".join(rng.choice("ab\0") for _ in range(rng.randrange(70))) + base[a : a + rng.randrange(45, 100)] + "é" * rng.randrange(40)
        rows.append((rng.randrange(15), body * rng.randrange(1, 3), "en", "s", 1))
    assert removed(spark, rows) == brute_removed(rows)


def test_suffix_dedup_empty(spark):
    assert not removed(spark, [])


def brute_fingerprint(body):
    w = words(ascii_lower(body))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, f"{prints[k]:016x}", least.get(find(k))) for k, i in enumerate(ids))


def test_simhash_of_texts(spark):
    rows = corpus(60) + awkward()
    found = simhash.classes(frames(spark, rows), 3, 3)
    found = Counter(tuple(r) for r in found.select("doc_id", simhash.hexed(simhash.F.col("fp")), "component_id").collect())
    assert found == brute_components([r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows])
    assert simhash.classes(empty(spark), 3, 3).count() == 0


def test_simhash_links_are_all_found(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for k in range(160):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in found} == want
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    reach = brute_components(signed, [s % 2**64 for s in signed])
    assert {(s, roots.get(s, s)) for s in signed} == {(i, c) for i, _, c in reach}


def test_long_chain_of_components(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1001)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(1, 201)) and found[1001] == 1000


def benchmark(spark, extra=()):
    rng = random.Random(11)
    rows = [(k, prose(rng, 30 + k, ("blo", "fri", "sku", "wen", "za", "or"))) for k in range(6)]
    return rows, spark.createDataFrame([*rows, *extra], "item_id long, text string")


def test_decontamination(spark):
    items, table = benchmark(spark, [(90, None), (91, ""), (0, "the er on")])
    rng = random.Random(12)
    rows = corpus(60)
    planted = {}
    for k, (item, body) in enumerate(items):
        w = body.split()
        changed = [x if j % 9 else "other" for j, x in enumerate(w)]  # a paraphrase of single words
        for doc, passage in ((200 + k, body), (300 + k, " ".join(changed)), (400 + k, body.upper())):
            rows.append((doc, prose(rng, 70) + " " + passage + " " + prose(rng, 70), "en", "s", 1))
            planted[doc] = item
    found = {r["doc_id"]: r["leaks"] for r in decontam.mark(frames(spark, rows), table).collect()}
    # The short item's words stand in some texts by chance: in order within one and a half times its length.
    bodies = {r[0]: r[1].lower().split() for r in rows}
    short = {d for d, w in bodies.items() if any(brute_common(["the", "er", "on"], w[k : k + 4]) == 3 for k in range(len(w)))}
    for doc, leaks in found.items():
        wanted = {planted[doc]} if doc in planted else set()
        assert {x["item_id"] for x in leaks} == wanted | ({0} if doc in short else set()), doc


def test_only_possible_leaks_are_compared(spark, monkeypatch):
    """Documents near an item by a few of its words are not compared word by word; what is found stays the same."""
    items, table = benchmark(spark)
    rng, rows = random.Random(13), corpus(600)
    rows = [(1000 + r[0], *r[1:]) for r in rows]
    for k in range(40):
        w = items[k % 6][1].split()
        part = w[: len(w) // 2] if k % 4 else [x if j % 9 else "other" for j, x in enumerate(w)]
        rows.append((k, prose(rng, rng.randint(0, 9)) + " " + " ".join(part) + " " + prose(rng, rng.randint(0, 9)), "en", "s", 1))
    latent = decontam.space(frames(spark, rows), [decontam.item_of(*r) for r in items])
    calls, plain = [], decontam.compared
    monkeypatch.setattr(decontam, "compared", lambda item, region: calls.append((item, region)) or plain(item, region))
    batch = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows]})
    found = [x for part in text.slices(batch) for x in decontam._leaks(part, latent)]
    assert [set(x) for x in found] == [{r[0] % 6} if r[0] < 1000 and r[0] % 4 == 0 else set() for r in rows]
    shares = [len(set(i.words).intersection(region)) / len(set(i.words)) for i, region in calls]
    assert shares and min(shares) >= decontam.LIKELY  # documents with half of an item were compared before


def test_decontamination_edges(spark):
    _, table = benchmark(spark)
    docs = frames(spark, awkward()).withColumn("leaks", simhash.F.lit(1))
    assert decontam.mark(docs, table).where("size(leaks) = 0").count() == len(awkward())
    assert decontam.mark(docs, table.where("false")).count() == len(awkward())
    assert decontam.mark(empty(spark), table).count() == 0


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        assert decontam.common(a, b) == brute_common(a, b)


def test_pipeline_stages(spark, tmp_path):
    items, table = benchmark(spark)
    rng = random.Random(13)
    rows = corpus(60) + [(i + 600 if i else i, *rest) for i, *rest in awkward()]
    rows.append((900, rows[0][1], "en", "s0", 1))  # a copy
    rows.append((901, prose(rng, 50) + " " + items[2][1] + " " + prose(rng, 50), "en", "s1", 1))
    docs = frames(spark, rows).withColumn("score", simhash.F.lit("mine")).withColumn("fp", simhash.F.col("doc_id"))
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, docs.where("false"), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        counts.append({r["doc_id"] for r in docs.collect()})
        assert {r["score"] for r in docs.collect()} == {"mine"}
    language, near, passages, clean = counts
    assert not {601, 602, 603} & language and set(range(60)) <= language
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] in language}
    assert 900 not in near and near <= language
    want = {c for _, _, c in brute_components(list(prints), list(prints.values())) if c is not None}
    assert {i for i in near if i is not None} == want
    assert 901 in passages and 901 not in clean and passages - clean == {901}
    sequences = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in sequences} == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean
