"""End to end: files on disk to catalogue tables."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox import Library, ingest_file, ingest_paths, mark_missing, recover, search, search_text, statistics, sync_folder
from shoebox.operators.stats import library_stats
from shoebox.sources import facts as fact_source
from tests import pictures


@pytest.fixture
def album(tmp_path):
    folder = tmp_path / "album"
    folder.mkdir()
    return folder


@pytest.fixture
def lib(spark, tmp_path):
    return Library(
        spark,
        str(tmp_path / "catalog"),
        str(tmp_path / "store"),
        encoder=pictures.mean_color_encoder,
        decoder=pictures.decode_png,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def write(path, pixels):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(pictures.png(pixels))
    return path


def test_sync_is_whole_idempotent_and_incremental(lib, album):
    base = pictures.textured(1)
    write(album / "a.png", base)
    shutil.copy(album / "a.png", album / "b.png")
    near = base.copy()
    near[0, 0] ^= 3
    write(album / "deep" / "_DSC1.PNG", near)
    write(album / "deep" / "other.png", pictures.textured(2))
    (album / "broken.jpg").write_bytes(b"no picture")
    (album / "notes.txt").write_text("not looked at")
    (album / ".png").write_bytes(b"a dot file has no extension")

    first = sync_folder(lib, str(album)).first()
    assert (first["ingested"], first["skipped"], first["errors"]) == (4, 0, 1)
    content = lib.table("content")
    assert rows(content, "id", "status", "dup_group", "near_dup_distance") == [
        (1, "INDEXED", 1, None), (2, "INDEXED", 1, 0), (3, "INDEXED", None, None)]
    files = lib.table("files")
    assert rows(files, F.element_at(F.split("local_path", "/"), -1), "content_id", "image_type") == [
        ("_DSC1.PNG", 2, "ORIGINAL"), ("a.png", 1, "ORIGINAL"), ("b.png", 1, "DUPLICATE"), ("other.png", 3, "ORIGINAL")]
    assert {r[0] for r in files.select("parent_folder_id").collect()} == {1}
    for key in [r[0] for r in content.select("sha256_hex").collect()]:
        assert os.path.exists(f"{lib.store_root}/photos/{key}")

    stats = library_stats(content, files).first()
    assert (stats["total_content"], stats["total_files"], stats["dupes"], stats["indexed"]) == (3, 4, 1, 3)
    assert stats["near_dup_count"] == 2 and stats["saved_bytes"] == os.path.getsize(album / "a.png")

    again = sync_folder(lib, str(album)).first()
    assert (again["ingested"], again["skipped"], again["errors"]) == (0, 4, 1)
    assert lib.table("content").count() == 3 and lib.table("files").count() == 4

    vector = lib.table("vectors").where("id = 3").first()["embedding"]
    assert search(lib.table("vectors"), vector).first()["id"] == 3

    def text_encoder():
        return lambda texts: np.array([vector for _ in texts])

    found = search_text(lib, "the other picture", text_encoder, k=1).first()
    assert found["id"] == 3 and found["s3_path"].startswith("library/photos/")
    whole = statistics(lib).first()
    assert whole["indexed"] == 3 and whole["index_bytes"] == 3 * 8 * 4 and whole["last_upload"] is not None

    # b.png now shows the other picture: one row per path, pointing at the known content.
    shutil.copy(album / "deep" / "other.png", album / "b.png")
    os.utime(album / "b.png", (2_000_000_000, 2_000_000_000))
    third = sync_folder(lib, str(album)).first()
    assert (third["ingested"], third["skipped"]) == (1, 3)
    assert rows(lib.table("files").where("local_path like '%/b.png'"), "id", "content_id", "image_type") == [
        (2, 3, "DUPLICATE")]

    (album / "a.png").unlink()
    mark_missing(lib, str(album))
    assert rows(lib.table("files").where("not present_locally"), "id") == [(1,)]
    assert lib.table("content").count() == 3


def test_single_file_paths_policies_and_errors(lib, album):
    base = pictures.textured(5)
    first = write(album / "one.data", base)  # named files need no picture extension
    assert ingest_file(lib, str(first), policy="discard") == 1
    near = base.copy()
    near[3, 3] ^= 1
    write(album / "two.png", near)
    assert ingest_file(lib, str(album / "two.png"), policy="discard") == 1
    assert rows(lib.table("files"), "id", "content_id", "image_type") == [(1, 1, "ORIGINAL"), (2, 1, "SIMILAR")]
    assert rows(lib.table("synced_folders"), "parent_folder_path", "title") == [("/", "Orphan Files")]
    assert lib.table("content").count() == 1 and lib.table("content").first()["status"] == "INDEXED"
    with pytest.raises(FileNotFoundError):
        ingest_file(lib, str(album / "absent.png"))
    with pytest.raises(ValueError):
        ingest_paths(lib, [str(first)], policy="ask")
    with pytest.raises(NotADirectoryError):
        sync_folder(lib, str(album / "absent"))


def test_offline_store_leaves_recoverable_state(spark, tmp_path, album):
    write(album / "x.png", pictures.textured(7))
    blocked = tmp_path / "store"
    blocked.write_text("a file where the store should be")
    lib = Library(spark, str(tmp_path / "catalog"), str(blocked), encoder=pictures.mean_color_encoder,
                  decoder=pictures.decode_png)
    assert sync_folder(lib, str(album)).first()["errors"] == 1
    row = lib.table("content").first()
    assert row["status"] == "UPLOADING" and lib.table("vectors").isEmpty() and lib.table("files").isEmpty()
    blocked.unlink()
    assert sync_folder(lib, str(album)).first()["ingested"] == 1
    row = lib.table("content").first()
    assert (row["id"], row["status"]) == (1, "INDEXED") and lib.table("vectors").count() == 1
    assert rows(lib.table("files"), "image_type") == [("ORIGINAL",)]


def _failing_encoder():
    def encode(_payloads):
        raise RuntimeError("model is down")

    return encode


def test_failed_embedding_is_picked_up_by_recover(lib, album):
    write(album / "x.png", pictures.textured(8))
    good, lib.encoder = lib.encoder, _failing_encoder
    assert sync_folder(lib, str(album)).first()["errors"] == 1
    assert lib.table("content").first()["status"] == "ERROR"
    lib.encoder = good
    # Path and time are known, so a sync skips the file; the stored object is still there.
    assert sync_folder(lib, str(album)).first()["skipped"] == 1
    assert recover(lib).where("error is null").count() == 1
    assert lib.table("content").first()["status"] == "INDEXED"


def test_large_file_goes_by_parts_and_resumes(spark, tmp_path, album):
    noise = np.random.default_rng(0).integers(0, 255, (64, 64, 3)).astype(np.uint8)
    big = write(album / "big.png", noise)
    size = os.path.getsize(big)
    lib = Library(spark, str(tmp_path / "catalog"), str(tmp_path / "store"), decoder=pictures.decode_png,
                  single_put_limit=4096, part_size=4096)
    # A plain file where part 2 should lie makes that part fail.
    assert sync_folder(lib, str(album)).first()["ingested"] == 1
    parts = lib.table("upload_parts")
    assert parts.count() == -(-size // 4096)
    assert rows(parts, "upload_status") == [("UPLOADED",)] * parts.count()
    assert sum(r[0] for r in parts.select("part_size").collect()) == size
    assert lib.table("uploads").first()["status"] == "UPLOADED"
    sha = lib.table("content").first()["sha256_hex"]
    assert (tmp_path / "store" / "photos" / sha).read_bytes() == big.read_bytes()
    # Pretend one part was lost on the way and the content was never finished.
    ledger = parts.withColumn(
        "upload_status", F.when(F.col("part_number") == 2, "ERROR").otherwise(F.col("upload_status")))
    content = lib.table("content").withColumn("status", F.lit("UPLOADING"))
    uploads = lib.table("uploads").withColumn("status", F.lit("UPLOADING"))
    files = lib.table("files").where("false")
    lib.catalog.commit(replace={"upload_parts": ledger, "content": content, "uploads": uploads, "files": files})
    assert sync_folder(lib, str(album)).first()["ingested"] == 1
    assert lib.table("uploads").count() == 1 and lib.table("upload_parts").count() == parts.count()
    assert rows(lib.table("upload_parts"), "upload_status") == [("UPLOADED",)] * parts.count()
    assert lib.table("content").first()["status"] == "UPLOADED"


def test_spark_image_source_hashes(spark, album):
    base = pictures.textured(3)
    near = base.copy()
    near[5, 5] ^= 2
    alpha = np.concatenate([base, np.full(base.shape[:2] + (1,), 255, np.uint8)], axis=2)
    write(album / "base.png", base)
    write(album / "near.png", near)
    write(album / "alpha.png", alpha)
    write(album / "other.png", pictures.textured(4))
    write(album / "half.png", base[::2, ::2])
    (album / "copy.tif").write_bytes(pictures.tiff(base))
    (album / "bad.png").write_bytes(b"broken")
    hashes = {os.path.basename(r["path"]): r["phash"] for r in fact_source.image_source_hashes(spark, str(album)).collect()}
    assert hashes["bad.png"] is None
    assert hashes["base.png"] == hashes["alpha.png"] == hashes["copy.tif"]
    bits = {n: int(h, 16) for n, h in hashes.items() if h}
    assert (bits["base.png"] ^ bits["near.png"]).bit_count() <= 5
    assert (bits["base.png"] ^ bits["half.png"]).bit_count() <= 10
    assert (bits["base.png"] ^ bits["other.png"]).bit_count() > 10


def test_facts_of_payload_column(spark, album):
    write(album / "base.png", pictures.textured(3))
    (album / "bad.png").write_bytes(b"broken")
    loaded = spark.read.format("binaryFile").load(str(album))
    facts = {os.path.basename(r["path"]): r for r in fact_source.facts_of_payload(loaded, pictures.decode_png).collect()}
    assert facts["bad.png"]["error"] and len(facts["base.png"]["sha256_hex"]) == 64
    assert facts["base.png"]["mime"] == "image/png" and facts["base.png"]["phash"]
