"""Hand-made cases for the small operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox import schemas, settings
from shoebox.functions import paths, vectors
from shoebox.functions.pixels import hash_picture, shrink
from shoebox.operators import checks, embedding, exact, filters, folders, lifecycle, parts, search, stats
from shoebox.session import dense_order
from tests import pictures

NOON = datetime(2024, 5, 1, 12)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_paths(spark):
    names = ["/a/x.JPG", "/a/.jpg", "/a/b.c/noext", "/a/y.tar.png", "/a/z.", "/a/q.weird", "plain.gif"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: (r["e"], r["m"], r["i"]) for r in df.select(
        "path", paths.extension("path").alias("e"), paths.mime_type("path").alias("m"), paths.is_image_path("path").alias("i")
    ).collect()}
    assert got == {
        "/a/x.JPG": (".jpg", "image/jpeg", True), "/a/.jpg": ("", settings.UNKNOWN_MIME, False),
        "/a/b.c/noext": ("", settings.UNKNOWN_MIME, False), "/a/y.tar.png": (".png", "image/png", True),
        "/a/z.": ("", settings.UNKNOWN_MIME, False), "/a/q.weird": (".weird", settings.UNKNOWN_MIME, False),
        "plain.gif": (".gif", "image/gif", True)}
    assert all(paths_ext in settings.MIME_TYPES for paths_ext in settings.IMAGE_EXTENSIONS)


def test_human_bytes_titles_and_keys(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 5 * 1024**3, 3 * 1024**4, 5000 * 1024**4]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")

    def expected(b):
        for unit in ("B", "KB", "MB", "GB"):
            if b < 1024:
                return f"{b:3.1f} {unit}"
            b /= 1024
        return f"{b:.1f} TB"

    assert [r[0] for r in df.orderBy("s").select(paths.human_bytes("s")).collect()] == [expected(s) for s in sizes]
    titles = spark.createDataFrame([("", "/a/b"), (None, "/a/c"), ("T", "/a/d")], "title string, path string")
    assert rows(titles.select(paths.folder_title("title", "path"))) == [("T",), ("b",), ("c",)]
    key = spark.createDataFrame([("ab",)], "sha string")
    assert rows(key.select(paths.object_key("sha"), paths.object_path("bucket", "sha"))) == [("photos/ab", "bucket/photos/ab")]


def test_vectors_and_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<float>")
    unit = {r["id"]: r["u"] for r in df.select("id", vectors.l2_normalize("v").alias("u")).collect()}
    assert unit[1] == pytest.approx([0.6, 0.8]) and np.isnan(unit[2]).all()


def index(spark, *vecs):
    return spark.createDataFrame([(i, f"photos/{i}", v) for i, v in enumerate(vecs)], "id long, s3_path string, embedding array<float>")


def test_search_threshold_ties_nan_null_and_k(spark):
    edge = [0.22, float(np.sqrt(1 - 0.22**2))]
    vecs = index(spark, [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [2.0, 0.0], [0.21, float(np.sqrt(1 - 0.21**2))], edge)
    got = rows(search.search(vecs, [5.0, 0.0], threshold=0.2199999), "id", "s3_path")
    assert got == [(0, "photos/0"), (4, "photos/4"), (6, "photos/6")]
    assert [r["id"] for r in search.search(vecs, [1.0, 0.0], k=1).collect()] == [0]
    assert [r["id"] for r in search.search(vecs, [1.0, 0.0], k=2).collect()] == [0, 4]
    # k larger than the table; zero and NULL vectors never take a place.
    assert len(search.search(vecs, [1.0, 0.0], k=50, threshold=None).collect()) == 5
    assert search.search(vecs, [-1.0, 0.0]).collect() == []
    assert search.search(vecs.where("false"), [1.0, 0.0]).collect() == []


def test_search_batch_slices_equal_single_searches(spark):
    rng = np.random.default_rng(3)
    vecs = index(spark, *rng.normal(size=(300, 16)).tolist()).repartition(5)
    wanted = rng.normal(size=(7, 16)).tolist()
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(wanted)], "query_id long, embedding array<float>")
    whole = rows(search.search_batch(vecs, queries, k=6), "query_id", "score", "id")
    sliced = rows(search.search_batch(vecs, queries, k=6, limit_bytes=16 * 8 * 2), "query_id", "score", "id")
    single = [(q, r["score"], r["id"]) for q, v in enumerate(np.float32(wanted).tolist()) for r in search.search(vecs, v, k=6).collect()]
    assert whole == sliced and [w[::2] for w in whole] == [s[::2] for s in sorted(single, key=str)]
    like = search.more_like_this(vecs, 4, k=3).collect()
    assert len(like) == 3 and all(r["id"] != 4 for r in like)
    with pytest.raises(ValueError):
        search.more_like_this(vecs, 10**6)


def test_stats_and_checks(spark):
    empty = stats.library_stats(spark.createDataFrame([], schemas.CONTENT), spark.createDataFrame([], schemas.FILES)).first()
    assert set(empty.asDict().values()) == {0}
    content = spark.createDataFrame(
        [(1, 10, "INDEXED", 1), (2, 20, "ERROR", 1), (3, 40, "INDEXED", None)], "id long, uploaded_bytes long, status string, dup_group long")
    files = spark.createDataFrame(
        [(1, "ORIGINAL"), (1, "DUPLICATE"), (1, "SIMILAR"), (2, "SIMILAR"), (3, "ORIGINAL")], "content_id long, image_type string")
    got = stats.library_stats(content, files).first().asDict()
    assert got == {"total_content": 3, "total_files": 5, "dupes": 3, "stored_bytes": 50, "saved_bytes": 30, "near_dup_count": 2, "indexed": 2}
    bad = spark.createDataFrame([(1, None, "p", "DONE"), (2, "s", "p", "ERROR"), (3, "s", None, None)], "id long, sha256_hex string, phash string, status string")
    assert rows(checks.check_violations(bad, "content")) == [
        (1, "sha256_hex not null"), (1, "status domain"), (3, "phash not null"), (3, "status not null")]
    assert rows(checks.unique_violations(bad, "content")) == [("s", 2)]
    assert rows(checks.fk_violations(files.withColumn("content_id", F.col("content_id") + 1), "content_id", content), "content_id") == [(4,)]
    assert rows(checks.release_missing(files.limit(5), "content_id", content.where("id <> 1")), "content_id").count((None,)) == 3


def test_folder_owner(spark):
    known = spark.createDataFrame([(1, "/p"), (2, "/"), (3, "/p/deep"), (4, "/q/")], "id long, parent_folder_path string")
    files = spark.createDataFrame([("/p2/x.jpg",), ("/p/deep/y.jpg",), ("/else/z.jpg",), ("/q/w.jpg",)], "path string")
    assert rows(folders.resolve_owner(files, known)) == [("/else/z.jpg", 2), ("/p/deep/y.jpg", 3), ("/p2/x.jpg", 1), ("/q/w.jpg", 4)]
    assert rows(folders.resolve_owner(files, known, bounded=True)) == [("/else/z.jpg", 2), ("/p/deep/y.jpg", 3), ("/p2/x.jpg", 2), ("/q/w.jpg", 4)]
    assert {r[1] for r in rows(folders.resolve_owner(files, known, explicit=F.lit(9)))} == {9}
    assert {r[1] for r in rows(folders.resolve_owner(files, known.where("false")))} == {None}
    registered = folders.register_folders(
        spark.createDataFrame([(5, "/p", NOON, "old")], schemas.FOLDERS),
        spark.createDataFrame([("/p", "new"), ("/r/s", None), ("/r/s", "")], "path string, title string"), F.lit(NOON))
    assert rows(registered, "id", "parent_folder_path", "title") == [(5, "/p", "old"), (6, "/r/s", "s")]
    orphan = folders.with_orphan_folder(registered, F.lit(NOON))
    assert orphan.count() == 3 and folders.with_orphan_folder(orphan, F.lit(NOON)).count() == 3


def test_incremental_and_missing(spark):
    # Times differ from the microsecond on.
    known = spark.createDataFrame([("/a", NOON, True), ("/b", NOON, True), ("/gone", NOON, True)], "local_path string, disk_mtime timestamp, present_locally boolean")
    scan = spark.createDataFrame([("/a", NOON), ("/b", NOON + timedelta(microseconds=1)), ("/new", NOON)], "path string, disk_mtime timestamp")
    assert rows(exact.incremental(scan, known), "path") == [("/b",), ("/new",)]
    assert rows(exact.missing_files(scan, known), "local_path") == [("/gone",)]
    assert rows(exact.mark_missing(scan, known), "local_path", "present_locally") == [("/a", True), ("/b", True), ("/gone", False)]


def test_upsert_branches(spark):
    old = spark.createDataFrame(
        [(1, "/same", "s1", 1, NOON, NOON, True, "ORIGINAL", 7, 3), (2, "/moved", "s2", 1, NOON, NOON, False, "ORIGINAL", 8, 3),
         (3, "/untouched", "s3", 1, NOON, NOON, True, "SIMILAR", 9, 3)], schemas.FILES)
    later = NOON + timedelta(days=1)
    batch = spark.createDataFrame(
        [(None, "/same", "x", 5, later, later, "DUPLICATE", 7, 4), (None, "/moved", "y", 6, later, later, "DUPLICATE", 7, 4),
         (9, "/fresh", "z", 7, later, later, "ORIGINAL", 10, 4)],
        "id long, path string, sha256_hex string, file_size long, discovered_at timestamp, disk_mtime timestamp, image_type string, content_id long, parent_folder_id long")
    got = {r["local_path"]: r for r in exact.upsert_files(old, batch).collect()}
    same, moved, fresh = got["/same"], got["/moved"], got["/fresh"]
    assert (same["sha256_hex"], same["file_size"], same["disk_mtime"], same["image_type"], same["parent_folder_id"]) == ("s1", 5, later, "ORIGINAL", 3)
    assert (moved["id"], moved["sha256_hex"], moved["content_id"], moved["image_type"], moved["parent_folder_id"], moved["discovered_at"]) == (2, "y", 7, "DUPLICATE", 3, NOON)
    assert moved["present_locally"] is True  # an ingested file is there, whatever was on record
    assert (fresh["id"], fresh["parent_folder_id"], fresh["present_locally"]) == (9, 4, True)
    assert got["/untouched"]["file_size"] == 1 and len(got) == 4


def test_dense_order_is_dense(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("k", F.xxhash64("id"))
    got = dense_order(df, "k", start=5).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(5, 1005)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert dense_order(df.where("false"), "k").count() == 0


MIB8 = settings.PART_SIZE


def test_parts(spark):
    sizes = spark.createDataFrame([(1, 0), (2, MIB8), (3, MIB8 + 1), (4, 2 * MIB8)], "upload_row_id long, total_size long")
    plan = parts.plan_parts(sizes)
    assert rows(plan, "upload_row_id", "part_number", "part_offset", "part_size") == [
        (3, 1, 0, MIB8), (3, 2, MIB8, 1), (4, 1, 0, MIB8), (4, 2, MIB8, MIB8)]
    ledger = spark.createDataFrame(
        [(1, 3, 1, "e1", "UPLOADED"), (2, 3, 2, None, "ERROR"), (3, 4, 2, "e3", "UPLOADED"), (4, 4, 1, "e4", "UPLOADED"), (5, 4, 1, None, "PENDING")],
        "id long, upload_row_id long, part_number int, part_etag string, upload_status string")
    assert rows(parts.pending_parts(plan, ledger), "upload_row_id", "part_number", "ledger_id") == [(3, 2, 2)]
    assert rows(parts.manifests(plan, ledger), "upload_row_id", F.to_json("manifest")) == [
        (4, '[{"part_number":1,"part_etag":"e4"},{"part_number":2,"part_etag":"e3"}]')]


def test_resume_and_reconcile(spark):
    def ago(days, seconds=0):
        return NOON - timedelta(days=days, seconds=-seconds)

    uploads = spark.createDataFrame(
        [(1, "a", 1, "UPLOADED", 1, ago(6)), (2, "b", 2, "UPLOADING", 1, ago(7)), (3, "c", 3, "UPLOADING", 1, ago(7, 1)),
         (4, None, 4, "PENDING", 1, ago(1)), (5, "e", 5, "ERROR", 1, ago(2)), (6, "f", 5, "UPLOADED", 1, ago(1)), (7, "g", 6, "UPLOADED", 1, ago(8))],
        schemas.UPLOADS)
    contents = spark.createDataFrame([(i,) for i in range(1, 8)], "content_id long")
    assert rows(parts.resume_decisions(contents, uploads, F.lit(NOON))) == [
        (1, "done", 1, "a"), (2, "fresh", None, None), (3, "resume", 3, "c"), (4, "fresh", None, None),
        (5, "resume", 5, "e"), (6, "fresh", None, None), (7, "fresh", None, None)]
    listed = spark.createDataFrame([("b",), ("orphan",), ("a",)], "upload_id string")
    got = {r["upload_id"]: r["action"] for r in parts.reconcile(listed, uploads).collect()}
    assert got == {"a": "none", "b": "resume", "c": "restart", "e": "restart", "f": "none", "g": "none", "orphan": "abort"}


def test_lifecycle_and_filters(spark):
    states = [(s, v) for s in settings.CONTENT_STATUSES for v in (None, [1.0])]
    df = spark.createDataFrame(states, "status string, embedding array<float>")
    assert df.where(filters.needs_embedding()).count() == 11 and df.where(filters.needs_embedding(force=True)).count() == 12
    assert rows(df.where(filters.is_stored()).select("status").distinct()) == [("INDEXED",), ("INDEXING",), ("UPLOADED",)]
    stored = {r[0]: r[1] for r in df.select("status", lifecycle.after_store(F.col("status"), F.lit(True))).collect()}
    failed = {r[0]: r[1] for r in df.select("status", lifecycle.after_store(F.col("status"), F.lit(None).cast("boolean"))).collect()}
    assert stored["PENDING"] == stored["ERROR"] == "UPLOADED" and stored["INDEXED"] == "INDEXED"
    assert failed["PENDING"] == failed["UPLOADING"] == "UPLOADING" and failed["INDEXING"] == "INDEXING"
    with pytest.raises(ValueError):
        filters.check_policy("ask")


def _picky():
    def encode(inputs):
        if any("bad" in v for v in inputs):
            raise ValueError("bad input")
        return np.ones((len(inputs), 4), dtype=np.float32)

    return encode


def test_embed_update_isolates_failures(spark):
    df = spark.createDataFrame(
        [(1, "UPLOADED", None, "ok"), (2, "UPLOADED", None, "bad"), (3, "INDEXED", [9.0], "bad"), (4, "ERROR", [7.0], "bad"), (5, "INDEXED", None, None)],
        "id long, status string, embedding array<float>, payload string").coalesce(1)
    got = {r["id"]: (r["status"], r["embedding"], r["embed_error"]) for r in embedding.embed_update(df, _picky).collect()}
    assert got == {1: ("INDEXED", [1.0] * 4, None), 2: ("ERROR", None, "ValueError: bad input"), 3: ("INDEXED", [9.0], None),
                   4: ("ERROR", [7.0], "ValueError: bad input"), 5: ("ERROR", None, "no input")}
    with pytest.raises(Exception, match="bad input"):
        embedding.embed_queries(spark.createDataFrame([("bad",)], "text string"), _picky).collect()


def test_picture_hash_properties():
    base = pictures.textured(1)[:, :, 0].astype(float)
    assert shrink(base).shape == (32, 32) and shrink(base).mean() == pytest.approx(base.mean(), rel=0.02)
    assert shrink(np.ones((5, 3))).tolist() == np.ones((32, 32)).tolist()
    noisy = base + np.random.default_rng(0).normal(0, 4, base.shape)
    far = (int(hash_picture(base), 16) ^ int(hash_picture(noisy), 16)).bit_count()
    other = (int(hash_picture(base), 16) ^ int(hash_picture(pictures.textured(2)[:, :, 0]), 16)).bit_count()
    assert far <= 8 < other and hash_picture(np.zeros((4, 4))) == "0" * 16


def test_compare_folders(spark):
    a = spark.createDataFrame([("/a/1", "s1", 0), ("/a/2", "s2", 0b111), ("/a/3", "s3", -1), ("/a/4", "s1", 0)], "path string, sha256_hex string, bits long")
    b = spark.createDataFrame([("/b/1", "s1", 0)], "path string, sha256_hex string, bits long")
    assert rows(exact.compare(a, b), "path") == [("/a/3",)]
