"""The stored hash index, components and the order-first set against brute force; what lookups read and how often graphs are joined."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.operators import first_come, hash_index, near_dup
from shoebox.operators.components import components
from shoebox.session import durable
from shoebox.sources.catalog import Catalog
from tests.model import distance
from tests.test_near_dup import clustered, signed


def hashes(spark, rows):
    return spark.createDataFrame([(i, signed(b)) for i, b in rows], "id long, bits long")


def stored(spark, tmp_path, *batches):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    for batch in batches:
        catalog.commit(append={"hashes": hash_index.index_rows(hashes(spark, batch))})
    return catalog


@pytest.mark.parametrize("threshold, few", [(5, 10_000), (3, 10_000), (5, 2), (7, 10_000)])
def test_near_equals_brute_force(spark, tmp_path, monkeypatch, threshold, few):
    monkeypatch.setattr(hash_index, "ROWS_PER_FOLDER", 40)  # the batches get levels 1 and 16
    rng = random.Random(threshold + few)
    rows = list(enumerate(clustered(rng, 240, spread=8)))
    index = stored(spark, tmp_path, rows[:30], rows[30:200], rows[200:], []).read("hashes")
    assert {r["of"] for r in index.select("of").distinct().collect()} == {1, 16}
    probes = clustered(random.Random(threshold + few), 60, spread=9)
    asked = spark.createDataFrame([(signed(b),) for b in probes] + [(None,)], "bits long")
    got = hash_index.near(index, asked, threshold, few).collect()
    want = {(i, signed(b)) for i, b in rows if any(distance(b, p) <= threshold for p in probes)}
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert sorted(r["id"] for r in hash_index.all_hashes(index).collect()) == [i for i, _ in rows]


def test_empty_index(spark, tmp_path):
    index = stored(spark, tmp_path).read("hashes")
    assert hash_index.near(index, hashes(spark, [(1, 5)])).collect() == []
    assert index.schema.names == schemas.HASHES.names


def test_lookup_reads_few_folders(spark, tmp_path):
    """A probe prunes the folders while the query runs, and reads a small part of the rows."""
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    many = spark.range(200_000).select("id", F.xxhash64("id").alias("bits"))
    catalog.commit(append={"hashes": hash_index.index_rows(many)})
    index = catalog.read("hashes")
    probe = durable(many.where("id = 77").select(F.col("bits").bitwiseXOR(F.lit(7)).alias("bits")))
    found = hash_index.near(index, probe)
    assert [r["id"] for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    folders = {tuple(r) for r in hash_index.keyed(probe, (hash_index.level_for(200_000),)).select("of", "mask", "bucket").collect()}
    touched = index.join(F.broadcast(spark.createDataFrame(sorted(folders), "of int, mask int, bucket int")), ["of", "mask", "bucket"]).count()
    assert len(folders) == 6 and touched < 200_000 * 6 / 16 * 2


def chain(n, step=5):
    """Hashes in a line, each near its neighbours only: disjoint bits flip from one to the next, two sets in turn."""
    rng = random.Random(n)
    out, at = [], 0
    seen = []
    while len(out) < n:
        at = rng.getrandbits(64) if not out else at
        bits = rng.sample(range(64), step)
        following = at
        for b in bits:
            following ^= 1 << b
        if all(distance(following, x) > step for x in seen[-40:-1]) and all(distance(following, x) > step for x in seen[:-1]):
            out.append(following)
            seen.append(following)
            at = following
    return out


def greedy(rows, held=(), threshold=5):
    kept = list(held)
    out = []
    for o, b in sorted(rows):
        if all(distance(b, x) > threshold for x in kept):
            kept.append(b)
            out.append(o)
    return out


def kept_orders(spark, rows, held=(), **options):
    fresh = spark.createDataFrame([(signed(b), o) for o, b in rows], "bits long, ord long")
    stored_rows = spark.createDataFrame([(signed(b), -1 - k) for k, b in enumerate(held)], "bits long, ord long")
    return sorted(r["ord"] for r in near_dup.keep_in_order(stored_rows, fresh, **options).collect())


def test_long_chain_takes_few_joins(spark, monkeypatch):
    line = chain(1000)
    calls = []
    join = near_dup.candidates
    monkeypatch.setattr(near_dup, "candidates", lambda *a, **k: calls.append(1) or join(*a, **k))
    rows = list(enumerate(line))
    assert kept_orders(spark, rows) == list(range(0, 1000, 2)) == greedy(rows)
    assert len(calls) <= 2


@pytest.mark.parametrize("task_edges, seed", [(1_000_000, 1), (40, 2), (15, 3)])
def test_order_first_set_equals_one_by_one(spark, monkeypatch, task_edges, seed):
    """Clusters, a chain and stored hashes, also with components cut up and clusters thinned out first."""
    monkeypatch.setattr(near_dup, "LINKS_PER_NODE", 1 if seed == 3 else 64)
    rng = random.Random(seed)
    pool = list(dict.fromkeys(clustered(rng, 120, spread=7) + chain(60)))
    rng.shuffle(pool)
    held, fresh = pool[:12], list(enumerate(pool[12:]))
    assert kept_orders(spark, fresh, held, task_edges=task_edges) == greedy(fresh, held)


def test_stretches(spark):
    rng = random.Random(8)
    edges = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(500)) if a != b}
    dropped = set()
    for later, earlier in sorted(edges):
        if earlier not in dropped:
            dropped.add(later)
    df = durable(spark.createDataFrame(sorted(edges), "later long, earlier long"))
    for size in (60, 10_000):
        assert {r["ord"] for r in first_come.dropped_nodes(df, size).collect()} == dropped


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 300) if k % 60] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(2000, k) for k in range(2001, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_lookup_is_not_slower_than_a_scan_by_much(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    many = durable(spark.range(500_000).select("id", F.xxhash64("id").alias("bits")))
    catalog.commit(append={"hashes": hash_index.index_rows(many)})
    index = catalog.read("hashes")
    probe = durable(many.where("id = 5").select("bits"))
    plain = many.where(F.bit_count(F.col("bits").bitwiseXOR(F.lit(probe.first()["bits"]))) <= 5)

    def best(query):
        spent = []
        for _ in range(3):
            began = time.perf_counter()
            query().collect()
            spent.append(time.perf_counter() - began)
        return min(spent)

    assert best(lambda: hash_index.near(index, probe)) < 5 * best(lambda: plain) + 2
