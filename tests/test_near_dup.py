"""Hamming join, grouping and suppression against brute force and the one-by-one model."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox.functions.bits import bits_to_hex, hamming_hex, hex_to_bits
from shoebox.operators import exact, first_come, near_dup
from shoebox.operators.hamming_join import block_count, candidates, masks
from shoebox.operators.running import last_before, sum_before
from shoebox.plans.decide import decide
from shoebox.workload import tables
from tests.model import Library, distance


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def clustered(rng, n, spread=4):
    """Hashes in clumps, a third of them around one center and sharing its low half."""
    centers = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    out = []
    for i in range(n):
        center = centers[0] if i % 3 == 0 else rng.choice(centers)
        low = 32 if i % 3 == 0 else 0
        for _ in range(rng.randint(0, spread)):
            center ^= 1 << rng.randint(low, 63)
        out.append(center)
    return out


def test_hex_bits_and_distance(spark):
    rows = [("ffffffffffffffff",), ("8000000000000001",), ("0000000000000000",), ("7fffffffffffffff",)]
    df = spark.createDataFrame(rows, "h string")
    got = df.select("h", hex_to_bits("h").alias("b"), bits_to_hex(hex_to_bits("h")).alias("back"),
                    hamming_hex("h", F.lit("0" * 16)).alias("d")).collect()
    for r in got:
        assert r["b"] == signed(int(r["h"], 16)) and r["back"] == r["h"] and r["d"] == int(r["h"], 16).bit_count()


@pytest.mark.parametrize("threshold,blocks,interleaved", [(5, 6, False), (5, 7, True), (5, 8, True), (3, 7, False), (0, 1, False)])
def test_masks_never_miss(threshold, blocks, interleaved):
    rng = random.Random(threshold * 31 + blocks)
    family = [m & (1 << 64) - 1 for m in masks(threshold, blocks, interleaved)]
    for _ in range(2000):
        flips = 0
        for _ in range(rng.randint(0, threshold)):
            flips |= 1 << rng.randint(0, 63)
        assert any(flips & m == 0 for m in family)
    assert block_count(5, 1000) == 6 and block_count(5, 10**7) == 7 and block_count(5, 10**9) == 8


@pytest.mark.parametrize("threshold,limit,blocks", [(5, 10**6, None), (5, 8, None), (5, 40, 7), (2, 5, None), (12, 10**6, None)])
def test_candidates_equal_brute_force(spark, threshold, limit, blocks):
    rng = random.Random(threshold + limit)
    left, right = sorted(set(clustered(rng, 150))), sorted(set(clustered(rng, 120)) | set(clustered(random.Random(threshold + limit), 60)))
    a = spark.createDataFrame([(signed(x),) for x in left], "a long")
    b = spark.createDataFrame([(signed(x),) for x in right], "b long")
    got = candidates(a, b, "a", "b", threshold, limit=limit, blocks=blocks).distinct().collect()
    want = {(signed(x), signed(y), distance(x, y)) for x in left for y in right if distance(x, y) <= threshold}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_boundary_distances_and_ties(spark):
    base = 0x8000000000000001
    stored = [(10, base ^ 0b11111), (3, base ^ (0b11111 << 20)), (7, base ^ (0b11111 << 20)), (1, base ^ (0b111111 << 40))]
    df = spark.createDataFrame([(i, signed(b)) for i, b in stored], "id long, bits long")
    probe = spark.createDataFrame([(signed(base),)], "bits long")
    # Distance 5 twice: the hash seen first (id 3) wins, its last content (7) stands for it; 6 is too far.
    assert [tuple(r) for r in near_dup.match_stored(probe, df).collect()] == [(signed(base), 7, 5)]


def test_chain_is_one_group_and_discard_keeps_both_ends(spark):
    a = 0
    b = a ^ 0b11111
    c = b ^ (0b11111 << 8)
    nothing = spark.createDataFrame([], "id long, bits long, dup_group long")
    fresh = spark.createDataFrame([(1, a), (2, b), (3, c), (4, signed(0xFFFFFFFF00000000))], "id long, bits long")
    groups = {tuple(r) for r in near_dup.group_keep(nothing, fresh).collect()}
    assert groups == {(1, 1, None), (2, 1, 5), (3, 1, 5)}
    none = spark.createDataFrame([], "bits long, ord long")
    kept = near_dup.keep_in_order(none, fresh.select("bits", F.col("id").alias("ord")))
    assert sorted(r["ord"] for r in kept.collect()) == [1, 3, 4]
    # A later copy of the dropped b meets c, which by then is as near but was kept later.
    owners = kept.withColumn("content_id", F.col("ord"))
    files = spark.createDataFrame([(2, b), (9, b)], "ord long, bits long")
    assert sorted(tuple(r) for r in near_dup.assign_similar(files, owners).collect()) == [(2, 1, 5), (9, 1, 5)]
    nearer = spark.createDataFrame([(1, a), (2, b ^ (0b11 << 30)), (3, b ^ (0b1111 << 40))], "ord long, bits long")
    owners = nearer.withColumn("content_id", F.col("ord"))
    got = near_dup.assign_similar(spark.createDataFrame([(2, b), (4, b), (9, b)], "ord long, bits long"), owners)
    assert sorted(tuple(r) for r in got.collect()) == [(2, 1, 5), (4, 2, 2), (9, 2, 2)]


def test_running_values_in_small_chunks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.choice([-1, 0, 1, 2]), rng.choice([None, i])) for i in range(-3, 90)]
    df = spark.createDataFrame(rows, "k string, o long, v long, x long")
    sums = {(r["k"], r["o"]): r["s"] for r in sum_before(df, "k", "o", "v", "s", rows_per_chunk=7).collect()}
    last = {(r["k"], r["o"]): r["l"] for r in last_before(df, "k", "o", "x", "l", rows_per_chunk=7).collect()}
    for k, o, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < o]
        assert sums[k, o] == sum(r[2] for r in before)
        assert last[k, o] == max((r[3] for r in before if r[3] is not None), default=None)


def _random_batch(rng, shas, pool, paths):
    chosen = rng.sample(paths, rng.randint(8, len(paths)))
    out = []
    for path in chosen:
        sha = rng.choice(shas)
        out.append((path, sha, pool[sha]))
    return out


@pytest.mark.parametrize("policy,seed", [("keep", 1), ("keep", 2), ("discard", 3), ("discard", 4)])
def test_batches_equal_one_by_one_model(spark, policy, seed):
    """Random batches with copies, re-pointed paths and interrupted stores, split paths forced."""
    rng = random.Random(seed)
    hashes = clustered(rng, 40, spread=6)
    pool = {f"sha{i:02d}": rng.choice(hashes) for i in range(45)}
    shas, paths = list(pool), [f"/p/{i:02d}" for i in range(60)]
    model = Library()
    for step in range(2):
        if step == 1:
            for cid in rng.sample(sorted(model.contents), 3):
                model.contents[cid]["status"] = "UPLOADING"
        batch = _random_batch(rng, shas, pool, paths)
        content = spark.createDataFrame(
            [(i, c["sha"], f"{c['bits']:016x}", c["group"], c["dist"], c["status"]) for i, c in model.contents.items()],
            "id long, sha256_hex string, phash string, dup_group long, near_dup_distance int, status string")
        files = spark.createDataFrame([(p, f["content"]) for p, f in model.files.items()], "local_path string, content_id long")
        facts = spark.createDataFrame([(p, s, f"{b:016x}", 1, "m") for p, s, b in batch],
                                      "path string, sha256_hex string, phash string, file_size long, mime string")
        before = {p: dict(f) for p, f in model.files.items()}
        held = content.where("status in ('UPLOADED', 'INDEXED', 'INDEXING')")
        decided = decide(facts, content, policy, limit=10)
        typed = exact.classify(decided.files, files, F.col("is_first"), F.col("is_similar"), rows_per_chunk=5)
        got = {r["path"]: (r["content_id"], r["image_type"]) for r in typed.collect()}
        stored = {r["id"]: r["sha256_hex"] for r in decided.to_store.collect()}
        labels = {}
        if policy == "keep":
            resumed = decided.to_store.where("not is_new").select("id")
            held = held.unionByName(content.join(resumed, "id", "left_semi"))
            held = held.select("id", hex_to_bits("phash").alias("bits"), "dup_group")
            fresh = decided.to_store.where("is_new").select("id", "bits")
            labels = {r["id"]: (r["dup_group"], r["near_dup_distance"]) for r in near_dup.group_keep(held, fresh, limit=10).collect()}
        old = {i: dict(c) for i, c in model.contents.items()}
        model.batch(batch, policy)
        for path, _, _ in batch:
            assert got[path][0] == model.files[path]["content"], path
            if path not in before or before[path]["content"] != got[path][0]:
                assert got[path][1] == model.files[path]["type"], path
        assert {i: c["sha"] for i, c in model.contents.items() if i not in old or old[i]["status"] == "UPLOADING"
                and c["status"] == "UPLOADED"} == stored
        if policy == "keep":
            for i, c in model.contents.items():
                group = labels.get(i, (old.get(i, {}).get("group"), None))[0]
                assert group == c["group"], i
                if i not in old:
                    assert labels.get(i, (None, None))[1] == c["dist"], i


def test_tasks_hold_few_pictures_and_edges_at_a_time():
    """Peaks of what a task's batch of texts, and of edges, takes in Python."""
    texts = pd.Series([f"picture {k} of {'abc' * (k % 50)}" for k in range(3000)])
    edges = pa.table({"later": np.arange(1, 300_001) + 10**9, "earlier": np.arange(300_000) + 10**9})
    peaks = []
    for work in (lambda: tables.text_phash.func(texts), lambda: first_come._settled(edges)):
        tracemalloc.start()
        out = work()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if len(peaks) == 1:
            assert out.tolist() == tables.phash_of_gray.func(tables.window_picture.func(texts)).tolist()
            assert tables.text_phash.func(texts[:0]).tolist() == []
    assert out.column("ord").to_pylist() == list(range(10**9 + 1, 10**9 + 300_001, 2))
    assert peaks[0] < 12_000_000  # 80 million before, with 8 KB or more a picture
    assert peaks[1] < 24_000_000  # 33 million before
