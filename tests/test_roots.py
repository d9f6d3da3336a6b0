"""Spellings of roots and names, presence of files, and writers that meet."""

import os

import pytest

from shoebox import Library, mark_missing, sync_folder
from shoebox.plans.ingest import ingest_paths
from shoebox.sources import facts, scan
from shoebox.sources.catalog import VersionTaken
from shoebox.sources.storage import plain
from tests import pictures

NAMES = ["plain.png", "my photo.png", "Ärger#1.png", "a+b%20.png"]


@pytest.fixture
def album(tmp_path):
    folder = tmp_path / "album"
    folder.mkdir()
    for k, name in enumerate(NAMES):
        (folder / name).write_bytes(pictures.png(pictures.textured(k)))
    return folder


def test_roots_are_one_spelling(spark, album, monkeypatch):
    monkeypatch.chdir(album.parent)
    whole = {str(album / n) for n in NAMES}
    for root in ("album", str(album), f"file://{album}", f"file:{album}"):
        assert {r["path"] for r in scan.list_images(spark, root).collect()} == whole
    assert plain("~/x") == os.path.expanduser("~/x") and plain("s3a://b/x y") == "s3a://b/x y"


def test_large_folders_are_listed_in_parts(spark, tmp_path):
    names = [f"{k}.jpg" for k in range(150)] + ["_x.png", "ü.png", "sub", "note.txt"]
    for name in names[:-2]:
        (tmp_path / name).write_bytes(b"x" * 7)
    (tmp_path / "note.txt").write_text("no picture")
    (tmp_path / "sub").mkdir()
    for k in range(30):
        (tmp_path / "sub" / f"{k}.gif").write_bytes(b"y")
    (tmp_path / "sub" / "circle").symlink_to(tmp_path)
    whole = sorted(str(tmp_path / n) for n in names[:-2]) + sorted(str(tmp_path / "sub" / f"{k}.gif") for k in range(30))
    for large in (20, 100, 10_000):
        files, unlisted = scan.list_tree(spark, str(tmp_path), large)
        assert sorted(r["path"] for r in files.collect()) == sorted(whole) and unlisted.isEmpty()
    assert files.where("path like '%.jpg'").select("file_size").distinct().collect()[0][0] == 7


def test_names_without_a_decoder(spark, album, monkeypatch):
    monkeypatch.setattr(facts, "pillow_decoder", lambda: None)
    monkeypatch.setattr(facts, "NAMED", 2)
    listed = scan.list_images(spark, f"file://{album}")
    for found in (facts.gather(listed, None, str(album)), facts.gather(listed)):
        assert {(r["path"], r["error"]) for r in found.collect()} == {(str(album / n), None) for n in NAMES}


def test_presence_follows_the_files(spark, album, tmp_path):
    lib = Library(spark, str(tmp_path / "catalog"), str(tmp_path / "store"), decoder=pictures.decode_png)
    odd = album / "one.data"  # named, not listed
    odd.write_bytes(pictures.png(pictures.textured(9)))
    ingest_paths(lib, [str(odd), str(album / NAMES[0])])
    away = tmp_path / "away.png"
    os.rename(album / NAMES[0], away)
    mark_missing(lib, str(album))
    present = {r["local_path"]: r["present_locally"] for r in lib.table("files").collect()}
    assert present == {str(odd): True, str(album / NAMES[0]): False}
    os.rename(away, album / NAMES[0])
    for name in NAMES[1:]:
        (album / name).unlink()
    assert tuple(sync_folder(lib, str(album)).first()) == (0, 1, 0)
    assert lib.table("files").where("present_locally").count() == 2


def test_folders_that_may_not_be_listed(monkeypatch):
    def closed(_path):
        class System:
            def get_file_info(self, _selector):
                raise PermissionError("closed")

        return System(), "/closed"

    import pyarrow as pa

    monkeypatch.setattr(scan, "locate", closed)
    found = [r for b in scan._list_folders(iter([pa.RecordBatch.from_pydict({"path": ["/closed"]})])) for r in b.to_pylist()]
    assert found == [{"path": "/closed", "is_dir": None, "file_size": None, "mtime_us": None}]


def test_two_writers_from_one_version(spark, tmp_path):
    from shoebox.schemas import TABLES
    from shoebox.sources.catalog import one_version

    one, two = (Library(spark, str(tmp_path / "catalog"), str(tmp_path / "store")) for _ in range(2))
    schema = TABLES["synced_folders"]

    def rows(lib, number):
        values = {"id": number, "parent_folder_path": f"/{number}"}
        extra = spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)
        return lib.table("synced_folders").unionByName(extra)

    with two.catalog.pinned():
        late = rows(two, 2)
        one.catalog.commit(replace={"synced_folders": rows(one, 1)})
        with pytest.raises(VersionTaken):
            two.catalog.commit(replace={"synced_folders": late})

    tries = []

    @one_version
    def add(lib, number):
        wanted = rows(lib, number)
        if not tries:
            one.catalog.commit(replace={"synced_folders": rows(one, 3)})
        tries.append(number)
        lib.catalog.commit(replace={"synced_folders": wanted})

    add(two, 2)
    assert tries == [2, 2]
    assert sorted(r["id"] for r in one.table("synced_folders").collect()) == [1, 2, 3]
