"""Watch streams over real folders and change tables."""

import os
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoebox import Library, watch_changes, watch_folder
from shoebox.schemas import CHANGES
from shoebox.streaming import folder
from shoebox.streaming import state as state_store
from shoebox.streaming.changes import drop_repeats, fold_latest
from shoebox.streaming.watch import new_files
from tests import pictures


@pytest.fixture
def lib(spark, tmp_path):
    return Library(spark, str(tmp_path / "catalog"), str(tmp_path / "store"), decoder=pictures.decode_png)


def put(path, pixels):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(pictures.png(pixels))
    return str(path)


def state(lib):
    return {os.path.basename(r["local_path"]): (r["content_id"], r["image_type"]) for r in lib.table("files").collect()}


def test_new_files_stream_resumes_from_its_checkpoint(spark, lib, tmp_path):
    album = tmp_path / "album"
    put(album / "a.png", pictures.textured(1))
    new_files(lib, str(album), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert state(lib) == {"a.png": (1, "ORIGINAL")}
    shutil.copy(album / "a.png", album / "b.PNG")
    (album / "c.txt").write_text("no picture")
    new_files(lib, str(album), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert state(lib) == {"a.png": (1, "ORIGINAL"), "b.PNG": (1, "DUPLICATE")}


def test_change_events_created_modified_and_repeated(spark, lib, tmp_path):
    album, feed = tmp_path / "album", str(tmp_path / "feed")
    one = put(album / "one.png", pictures.textured(1))
    gone = str(album / "gone.png")
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(one, t, "created"), (one, t, "created"), (gone, t, "created"), (one + ".txt", t, "created")], CHANGES).write.parquet(feed)

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(feed)
        watch_changes(lib, stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()

    run()
    assert state(lib) == {"one.png": (1, "ORIGINAL")}
    put(album / "one.png", pictures.textured(2))
    # An old time of change must not count as late.
    spark.createDataFrame([(one, datetime(2010, 1, 1), "modified")], CHANGES).write.mode("append").parquet(feed)
    run()
    assert state(lib) == {"one.png": (2, "ORIGINAL")}
    assert lib.table("content").count() == 2


def test_watch_folder_skips_what_was_there_logs_bad_files_and_restarts(spark, lib, tmp_path, caplog):
    album, checkpoint = tmp_path / "album", str(tmp_path / "cp")
    old = put(album / "old.png", pictures.textured(9))
    os.utime(old, (1_600_000_000, 1_600_000_000))

    def run():
        watch_folder(lib, str(album), checkpoint, availableNow=True).awaitTermination()

    run()  # the first offset is now
    assert state(lib) == {}
    put(album / "deep" / "a.png", pictures.textured(1))
    (album / "bad.png").write_bytes(b"no picture")
    (album / "notes.txt").write_text("no picture either")
    time.sleep(1.2)
    with caplog.at_level("WARNING"):
        run()
    assert state(lib) == {"a.png": (1, "ORIGINAL")}
    assert "bad.png" in caplog.text
    run()
    assert lib.table("files").count() == 1
    put(album / "deep" / "a.png", pictures.textured(2))
    put(album / "b.PNG", pictures.textured(1))
    time.sleep(1.2)
    run()
    assert state(lib) == {"a.png": (2, "ORIGINAL"), "b.PNG": (1, "DUPLICATE")} or state(lib) == {"a.png": (2, "ORIGINAL"), "b.PNG": (1, "ORIGINAL")}
    # From an earlier time on, the file that was there is found as well.
    again = watch_folder(lib, str(album), str(tmp_path / "other"), since=datetime(2020, 1, 1), availableNow=True)
    again.awaitTermination()
    assert "old.png" in state(lib)


def test_folder_offsets_give_the_same_files_again(tmp_path):
    for k in range(40):
        put(tmp_path / f"d{k % 3}" / f"{k}.png", pictures.textured(1))
        os.utime(tmp_path / f"d{k % 3}" / f"{k}.png", ns=(0, (1_700_000_000 + k) * 10**9))
    (tmp_path / "closed").mkdir()
    (tmp_path / "circle").symlink_to(tmp_path)
    stream = folder.FolderStream({"path": str(tmp_path), "parts": "5", "since": str(1_700_000_000 * 10**6), "span": "10"})
    at, seen = stream.initialOffset(), []
    while True:
        end = stream.latestOffset()
        shares = stream.partitions(at, end)
        got = sorted(r[0] for s in shares for r in stream.read(s))
        assert got == sorted(r[0] for s in stream.partitions(at, end) for r in stream.read(s))
        if end["us"] - 1_700_000_000 * 10**6 <= 40 * 10**6:
            assert len(got) <= 10  # at most ``span`` seconds of changes
        seen += got
        stream.commit(end)
        at = end
        if end["us"] > 1_700_000_100 * 10**6:
            break
    assert sorted(seen) == sorted(str(tmp_path / f"d{k % 3}" / f"{k}.png") for k in range(1, 40))
    with pytest.raises(NotADirectoryError):
        folder.FolderStream({"path": str(tmp_path / "nowhere")})


def test_fold_latest_over_several_batches_and_restarts(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "path string, mtime timestamp, n long"

    def day(d):
        return datetime(2024, 1, d)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        out = fold_latest(stream, str(tmp_path / "cp"), ["mtime", "n"])
        return sorted(tuple(r) for r in out.select("path", "n").collect())

    for part in ([("a", day(1), 1), ("b", day(5), 2)], [("a", day(2), 3), ("b", day(4), 4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
    assert run() == [("a", 3), ("b", 2)]
    assert run() == [("a", 3), ("b", 2)]
    spark.createDataFrame([("c", day(1), 5)], schema).coalesce(1).write.mode("append").parquet(feed)
    assert run() == [("a", 3), ("b", 2), ("c", 5)]


def test_fold_of_an_empty_feed(spark, tmp_path):
    schema = "path string, mtime timestamp, n long"
    (tmp_path / "feed").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    assert fold_latest(stream, str(tmp_path / "cp"), ["mtime", "n"]).collect() == []


def test_latest_changes_pass_on_what_is_new(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "path string, mtime timestamp, n long"
    # In another file order than by time: repeats and overtaken changes do not come out.
    for path, day in [("a", 3), ("a", 1), ("a", 3), ("b", 1), ("a", 4)]:
        spark.createDataFrame([(path, datetime(2024, 1, day), 0)], schema).coalesce(1).write.mode("append").parquet(feed)
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(feed)
    with state_store.rocksdb(spark):
        run = state_store.latest_changes(stream, ["mtime", "n"]).writeStream.format("memory").queryName("latest").outputMode("update")
        run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = [(r["path"], r["mtime"].day) for r in spark.table("latest").collect()]
    assert sorted(out) == [("a", 3), ("a", 4), ("b", 1)]
    assert {(r["path"], r["mtime"].day) for r in state_store.read_latest(spark, str(tmp_path / "cp"), stream.schema).collect()} == {("a", 4), ("b", 1)}


class Handle:
    """What a processor sees of the store, for one key."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 1000

    def getValueState(self, name, columns):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_a_silent_path_is_forgotten():
    handle, columns = Handle(), StructType.fromDDL("path string, mtime long, n long")
    processor = state_store.LatestChange(columns, ["mtime", "n"], forget_ms=500)
    processor.init(handle)

    def hear(*rows):
        return [tuple(r) for r in processor.handleInputRows(("a",), iter([dict(zip(columns.names, r)) for r in rows]), handle)]

    assert hear(("a", 5, 1), ("a", 7, 1), ("a", None, 9)) == [("a", 7, 1)] and handle.timers == {1500}
    handle.now = 1400
    assert hear(("a", 7, 1), ("a", 6, 9)) == [] and handle.timers == {1900}  # repeats keep it alive
    assert hear(("a", 7, 2)) == [("a", 7, 2)] and handle.value == ("a", 7, 2)
    assert list(processor.handleExpiredTimer(("a",), handle, None)) == [] and not handle.exists()
    assert hear(("a", 1, 1)) == [("a", 1, 1)]


def test_repeats_are_dropped_whatever_their_age(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "path string, mtime timestamp"
    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("a", datetime(2001, 1, 1)), ("b", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(feed)
    out = drop_repeats(spark.readStream.schema(schema).parquet(feed))
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
