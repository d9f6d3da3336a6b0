"""Find picture files.

Folders are listed level by level inside tasks, entry by entry; a folder with very many names is dealt over tasks by name. Spark's own file sources would skip names that
start with an underscore or a dot (cameras write ``_DSC0001.JPG``) and keep the status of every
file on the driver.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators.filters import images_only
from shoebox.session import durable
from shoebox.sources.storage import ControlFiles, locate, plain

ENTRY = "path string, is_dir boolean, file_size long, mtime_us long"
ENTRY_ARROW = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("file_size", pa.int64()), ("mtime_us", pa.int64())])
LISTED = "path string, file_size long, disk_mtime timestamp"
BATCH = 10_000  # entries handed on at once
LARGE = 100_000  # names of one folder that a task holds; a folder with more is listed by ``PARTS`` tasks
PARTS = 64
TOO_LARGE = -1  # in place of a size: the folder is to be listed in parts


def part_of(name: str, parts: int) -> int:
    """Which of the parts of a folder a name belongs to, in any process."""
    return zlib.crc32(os.fsencode(name)) % parts


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY_ARROW)], schema=ENTRY_ARROW)


def _entry(entry: os.DirEntry) -> tuple | None:
    """One entry of a local folder; None for what is neither a file nor a folder, or is gone, or may close a circle."""
    try:
        if entry.is_dir():
            return None if entry.is_symlink() else (entry.path, True, None, 0)
        if entry.is_file():
            status = entry.stat()
            return entry.path, False, status.st_size, status.st_mtime_ns // 1000
    except OSError:
        pass
    return None


def _list_local(folder: str, part: int, parts: int, large: int) -> Iterator[list[tuple]]:
    """Entries of one local folder, a batch at a time; names are held only until it is known that they are few."""
    held: list | None = [] if parts == 1 else None
    rows: list[tuple] = []
    with os.scandir(folder) as names:
        for entry in names:
            if held is not None:
                held.append(entry)
                if len(held) > large:
                    yield [(folder, None, TOO_LARGE, None)]
                    return
            elif part_of(entry.name, parts) == part and (row := _entry(entry)):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield rows
                    rows = []
    for entry in held or ():
        if row := _entry(entry):
            rows.append(row)
    for first in range(0, len(rows), BATCH):
        yield rows[first : first + BATCH]


def _list_folders(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, part, parts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            system, path = locate(folder)
            try:
                if isinstance(system, arrow_fs.LocalFileSystem):
                    yield from map(_packed, _list_local(path, part, parts, large))
                    continue
                infos = system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
            except FileNotFoundError:
                continue
            except PermissionError:
                yield _packed([(folder, None, None, None)])
                continue
            prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
            rows = []
            for info in infos:
                is_dir = info.type == arrow_fs.FileType.Directory
                if is_dir or info.type == arrow_fs.FileType.File:
                    mtime = info.mtime_ns // 1000 if info.mtime_ns is not None else 0
                    rows.append((prefix + info.path, is_dir, None if is_dir else info.size, mtime))
            yield _packed(rows)


def _stat_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, sizes, times, there = batch.column(0).to_pylist(), [], [], []
        for one in paths:
            system, path = locate(one)
            try:
                info = system.get_file_info(path)
            except OSError:  # cannot be looked at: neither there nor gone
                sizes.append(None), times.append(None), there.append(None)
                continue
            found = info.type == arrow_fs.FileType.File
            sizes.append(info.size if found else None)
            times.append(info.mtime_ns // 1000 if found and info.mtime_ns is not None else None)
            there.append(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64()), pa.array(there, pa.bool_())],
            names=["path", "file_size", "mtime_us", "found"],
        )


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """All picture files below ``root``: ``path``, ``file_size``, ``disk_mtime``."""
    return list_tree(spark, root)[0]


def list_tree(spark: SparkSession, root: str, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The picture files below ``root``, and the folders (``path``) that may not be listed.

    A local folder of more than ``large`` names is listed in parts; other file systems give a folder's entries at once.
    """
    root = plain(root)
    if not ControlFiles(spark, root).is_dir(root):
        raise NotADirectoryError(f"no folder to list at {root}")
    frontier = spark.createDataFrame([(root.rstrip("/") or "/", 0, 1)], "path string, part int, parts int")
    tasks = spark.sparkContext.defaultParallelism
    files = unlisted = None
    while True:
        entries = durable(frontier.repartition(tasks, "path", "part").mapInArrow(lambda batches: _list_folders(batches, large), ENTRY))
        level = images_only(entries.where("not is_dir"))
        files = level if files is None else files.unionByName(level)
        closed = entries.where("is_dir is null and file_size is null").select("path")
        unlisted = closed if unlisted is None else unlisted.unionByName(closed)
        crowded = entries.where(F.col("is_dir").isNull() & (F.col("file_size") == TOO_LARGE))
        frontier = entries.where("is_dir").select("path", F.lit(0).alias("part"), F.lit(1).alias("parts")).unionByName(
            crowded.select("path", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(PARTS).alias("parts"))
        )
        if frontier.isEmpty():
            break
        tasks = max(tasks, 4 * spark.sparkContext.defaultParallelism)
    return files.select("path", "file_size", F.timestamp_micros("mtime_us").alias("disk_mtime")), unlisted


def stat_paths(paths: DataFrame) -> DataFrame:
    """Size and time of change of named files (``path``); NULL size where there is no such file, ``found``
    false where it is known to be gone.

    Named files are taken as they are: no test of the extension.
    """
    named = paths.select("path").distinct().mapInArrow(
        _stat_files, "path string, file_size long, mtime_us long, found boolean"
    )
    return named.select("path", "file_size", F.timestamp_micros("mtime_us").alias("disk_mtime"), "found")
