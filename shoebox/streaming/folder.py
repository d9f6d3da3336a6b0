"""Streaming source of file changes below a folder: ``spark.readStream.format("shoebox_folder").option("path", root)``.

An offset is a time: a batch has the files whose time of change lies after its start and up to its end, so the same offsets give
the same files after a restart, each change is in one batch, and a file that changes again is in a later one. Files that were there
before the first start are not looked at unless ``since`` names an earlier time. A batch covers at most ``span`` seconds
of changes, so a long pause is caught up piece by piece, and ends ``settle`` seconds ago, when files are whole.

Tasks walk the folder entry by entry, each with its own share of the names, and look at the times of that share only. What cannot be
looked at is passed over and logged.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shoebox.sources.scan import part_of

NAME = "shoebox_folder"
SCHEMA = "path string, file_size long, mtime timestamp"
SECOND = 1_000_000
LOG = logging.getLogger(__name__)


class Share(InputPartition):
    """One task's share of the names, and the times of change to look for."""

    def __init__(self, part: int, parts: int, after: int, upto: int):
        self.part, self.parts, self.after, self.upto = part, parts, after, upto


def changed_files(root: str, share: Share) -> Iterator[tuple[str, int, int]]:
    """Path, size and time of change (microseconds) of the share's files that changed in its stretch of time."""
    folders = [root]
    while folders:
        try:
            entries = os.scandir(folders.pop())
        except OSError as problem:
            LOG.warning("folder passed over: %s", problem)
            continue
        with entries:
            for entry in entries:
                try:
                    if entry.is_dir():
                        if not entry.is_symlink():  # a link to a folder may close a circle
                            folders.append(entry.path)
                    elif part_of(entry.path, share.parts) == share.part and entry.is_file():
                        status = entry.stat()
                        if share.after < status.st_mtime_ns // 1000 <= share.upto:
                            yield entry.path, status.st_size, status.st_mtime_ns // 1000
                except OSError as problem:
                    LOG.warning("file passed over: %s", problem)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file:").rstrip("/") or "/"
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"no folder to watch at {self.root}")
        self.parts = int(options.get("parts", 8))
        self.settle, self.span = (int(float(options.get(k, v)) * SECOND) for k, v in (("settle", 1), ("span", 86_400)))
        self.since = options.get("since")
        self.at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = int(self.since) if self.since is not None else time.time_ns() // 1000
        return {"us": self.at}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time_ns() // 1000 - self.settle
        if self.at is None:
            return {"us": now}
        return {"us": max(self.at, min(now, self.at + self.span))}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.at = end["us"]
        return [Share(k, self.parts, start["us"], end["us"]) for k in range(self.parts)]

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["us"])

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, size, changed in changed_files(self.root, partition):
            yield path, size, datetime.fromtimestamp(changed // SECOND, timezone.utc).replace(microsecond=changed % SECOND)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self.options)


def folder_changes(spark: SparkSession, root: str, since: datetime | None = None, **options):
    """A stream of ``path``, ``file_size``, ``mtime`` of the files below ``root`` that change from now on, or from ``since``."""
    spark.dataSource.register(FolderSource)
    stream = spark.readStream.format(NAME).option("path", root)
    if since is not None:
        stream = stream.option("since", str(int(since.timestamp() * SECOND)))
    return stream.options(**{k: str(v) for k, v in options.items()}).load()
