"""Watch a folder: new and changed pictures are ingested batch by batch."""

from __future__ import annotations

import logging
from datetime import datetime

from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoebox.operators.exact import incremental, latest_per_path
from shoebox.operators.filters import images_only
from shoebox.plans.ingest import Library, ingest_paths
from shoebox.schemas import CHANGES
from shoebox.session import durable
from shoebox.sources import scan
from shoebox.sources.storage import locate, plain
from shoebox.streaming.changes import drop_repeats
from shoebox.streaming.folder import folder_changes

LOG = logging.getLogger(__name__)
LOGGED = 100  # failures of a batch that are named in the log


def _ingest(lib: Library, named: DataFrame) -> None:
    """Ingest the named files; what fails is logged and does not end the stream."""
    named = durable(named)
    if named.isEmpty():
        return
    failed = ingest_paths(lib, named).where("outcome = 'error'")
    for row in failed.limit(LOGGED).collect():
        LOG.warning("not ingested: %s: %s", row["path"], row["error"])


def watch_changes(lib: Library, feed: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Ingest a stream of change events (``path``, ``mtime``, ``kind``: created or modified).

    Repeated events are dropped; a batch that is replayed after a failure ingests the same files
    again and leaves the library as it is.
    """
    wanted = images_only(feed.select(*CHANGES.names).where(F.col("kind").isin("created", "modified")))

    def one_batch(batch: DataFrame, _batch_id: int) -> None:
        newest = latest_per_path(batch, ["mtime", "kind"])
        _ingest(lib, newest.select("path"))

    stream = drop_repeats(wanted).writeStream.foreachBatch(one_batch)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def watch_folder(
    lib: Library, root: str, checkpoint: str, seconds: int = 10, since: datetime | None = None, **trigger
) -> StreamingQuery:
    """Ingest files below ``root`` that are new or changed, looking every ``seconds``.

    A local (or mounted) folder is read by the folder source: its offsets are times of change, so files that were there before are
    left alone unless ``since`` names an earlier time, and a restart goes on where the checkpoint ends. Other file systems are listed at
    each tick. Either way files that the catalogue knows with that time are skipped. The owner folder follows from the path.
    """
    root = plain(root).rstrip("/") or "/"
    if not isinstance(locate(root)[0], LocalFileSystem):
        return _watch_by_listing(lib, root, checkpoint, seconds, since)
    changed = images_only(folder_changes(lib.spark, root, since, settle=min(1, seconds)))

    def one_batch(batch: DataFrame, _batch_id: int) -> None:
        newest = latest_per_path(durable(batch), ["mtime"]).withColumnRenamed("mtime", "disk_mtime")
        _ingest(lib, incremental(newest, lib.table("files")).select("path"))

    stream = changed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).start()


def _watch_by_listing(lib: Library, root: str, checkpoint: str, seconds: int, since: datetime | None) -> StreamingQuery:
    ticks = lib.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def one_tick(_batch: DataFrame, _batch_id: int) -> None:
        listed = scan.list_images(lib.spark, root)
        if since is not None:
            listed = listed.where(F.col("disk_mtime") >= F.lit(since))
        _ingest(lib, incremental(listed, lib.table("files")).select("path"))

    stream = ticks.writeStream.foreachBatch(one_tick).option("checkpointLocation", checkpoint)
    return stream.trigger(processingTime=f"{seconds} seconds").start()


def new_files(lib: Library, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Ingest files as Spark's own file stream finds them below ``root``: each path once."""
    found = (
        lib.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    paths = found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))

    def one_batch(batch: DataFrame, _batch_id: int) -> None:
        _ingest(lib, batch.select("path").distinct())

    stream = images_only(paths).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
