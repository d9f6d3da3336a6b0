"""Synced folders: owner of a path, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.paths import folder_title
from shoebox.session import dense_order


def resolve_owner(
    paths: DataFrame,
    folders: DataFrame,
    explicit: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ``parent_folder_id`` to rows with ``path``.

    An explicit id wins, then the folder with the longest path that is a prefix of the file's,
    then the orphan folder. A prefix is plain text: ``/p`` also owns ``/p2/x``; ``bounded=True``
    asks for whole path segments. A path is cut at the lengths that occur among the folders and
    the cuts are matched by equality, so no file meets a folder that does not own it.
    """
    real = folders.where(F.col("parent_folder_path") != settings.ORPHAN_PATH)
    lengths = [
        r[0]
        for r in real.select(F.length("parent_folder_path")).distinct().collect()  # at most the longest path
        if r[0] is not None
    ]
    distinct_paths = paths.select("path").distinct()
    cuts = F.filter(
        F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"),
        lambda n: n <= F.length("path"),
    )
    cut = distinct_paths.select("path", F.explode(cuts).alias("_n")).withColumn(
        "_prefix", F.expr("substring(path, 1, _n)")
    )
    if bounded:
        after = F.expr("substring(path, _n + 1, 1)")
        cut = cut.where(after.isin("/", "") | F.col("_prefix").endswith("/"))
    owner = (
        cut.join(
            real.select(F.col("parent_folder_path").alias("_prefix"), F.col("id").alias("_owner")),
            "_prefix",
        )
        .groupBy("path")
        .agg(F.max_by("_owner", "_n").alias("_owner"))
    )
    orphan = folders.where(F.col("parent_folder_path") == settings.ORPHAN_PATH)
    orphan_row = orphan.select("id").first()
    fallback = F.lit(orphan_row[0] if orphan_row else None).cast("long")
    wanted = explicit if explicit is not None else F.lit(None).cast("long")
    return (
        paths.join(owner, "path", "left")
        .withColumn("parent_folder_id", F.coalesce(wanted, F.col("_owner"), fallback))
        .drop("_owner")
    )


def register_folders(folders: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Folders with every row of ``wanted`` (``path``, ``title``) present once.

    Existing rows keep their id, date and title; a missing title becomes the folder's name.
    """
    unique = wanted.groupBy("path").agg(F.min("title").alias("title"))
    fresh = unique.join(
        folders.select(F.col("parent_folder_path").alias("path")), "path", "left_anti"
    )
    last = folders.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = dense_order(fresh, "path", name="id", start=last + 1)
    return folders.unionByName(
        numbered.select(
            "id",
            F.col("path").alias("parent_folder_path"),
            now.alias("added_at"),
            folder_title("title", "path").alias("title"),
        )
    )


def with_orphan_folder(folders: DataFrame, now: Column) -> DataFrame:
    """Add the folder that owns files outside all synced folders, if it is not there yet."""
    if not folders.where(F.col("parent_folder_path") == settings.ORPHAN_PATH).isEmpty():
        return folders
    wanted = folders.sparkSession.createDataFrame(
        [(settings.ORPHAN_PATH, settings.ORPHAN_TITLE)], "path string, title string"
    )
    return register_folders(folders, wanted, now)
