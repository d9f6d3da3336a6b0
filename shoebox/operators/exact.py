"""Exact duplicates: one content per hash, and the type of each file row.

Copies of one content may hold a large share of all files, so nothing here sorts or collects the
files of one hash in one task: first occurrences are plain aggregates and running counts are cut
in bounded stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.paths import object_key
from shoebox.operators.filters import is_stored
from shoebox.operators.running import sum_before


def first_per_hash(files: DataFrame, sha: str = "sha256_hex", order: str = "ord") -> DataFrame:
    """One row per hash: order value of its first file and number of files."""
    return files.groupBy(sha).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def lookup_stored(files: DataFrame, content: DataFrame) -> DataFrame:
    """Add ``content_id`` and ``content_status`` of the content with the same hash, if any."""
    known = content.select(
        "sha256_hex", F.col("id").alias("content_id"), F.col("status").alias("content_status")
    )
    return files.join(known, "sha256_hex", "left")


def to_store(files: DataFrame, content: DataFrame, sha: str = "sha256_hex") -> DataFrame:
    """Objects to put: one per hash that is not stored yet, with its key."""
    stored = content.where(is_stored()).select(F.col("sha256_hex").alias(sha))
    fresh = files.groupBy(sha).agg(F.count("*").alias("copies")).join(stored, sha, "left_anti")
    return fresh.select(sha, object_key(sha).alias("object_key"))


def incremental(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files (``path``, ``disk_mtime``) that are new or whose time of change differs.

    Times are compared at the microsecond, the precision of listings.
    """
    known = files.select(
        F.col("local_path").alias("path"), F.unix_micros("disk_mtime").alias("_us")
    )
    listed = scan.withColumn("_us", F.unix_micros("disk_mtime"))
    return listed.join(known, ["path", "_us"], "left_anti").drop("_us")


def missing_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """File rows still marked as present whose path was not scanned."""
    seen = scan.select(F.col("path").alias("local_path"))
    return files.where("present_locally").join(seen, "local_path", "left_anti")


def mark_missing(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Files with ``present_locally`` cleared where the path is gone; contents stay stored."""
    seen = scan.select(F.col("path").alias("local_path")).distinct().withColumn("_seen", F.lit(True))
    joined = files.join(seen, "local_path", "left")
    return joined.withColumn(
        "present_locally", F.col("present_locally") & F.col("_seen").isNotNull()
    ).select(*files.columns)


def latest_per_path(changes: DataFrame, order: list[str]) -> DataFrame:
    """Last change of every path; ``order`` names the columns that order changes of one path."""
    others = [c for c in changes.columns if c != "path"]
    newest = changes.groupBy("path").agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    )
    return newest.select("path", *[F.col(f"_last.{c}").alias(c) for c in others])


def has_files_before(
    batch: DataFrame,
    files: DataFrame,
    rows_per_chunk: int = settings.ROWS_PER_CHUNK,
) -> DataFrame:
    """Order values at which the file's content is already referenced by some file row.

    ``batch`` has ``ord``, ``path`` and ``content_id``: the files of one batch and the contents
    they end at. A path that leaves its old content takes one reference away at its turn and
    brings one to the new content. Returns ``ord``, ``has_files``.
    """
    old = files.select(
        F.col("local_path").alias("path"), F.col("content_id").alias("_old")
    )
    moves = batch.select("ord", "path", "content_id").join(old, "path", "left")
    moved = ~F.col("content_id").eqNullSafe(F.col("_old"))

    def event(content, at, delta, asked):
        return F.struct(
            content.alias("content_id"),
            at.alias("_at"),
            F.lit(delta).cast("long").alias("_delta"),
            asked.cast("long").alias("ord"),
        )

    # One content meets one turn at most twice: asking (2 * ord) comes before changing (2 * ord + 1).
    turn, nobody = F.col("ord") * 2, F.lit(None)
    events = F.array(
        event(F.col("content_id"), turn, 0, F.col("ord")),
        F.when(moved, event(F.col("content_id"), turn + 1, 1, nobody)),
        F.when(moved & F.col("_old").isNotNull(), event(F.col("_old"), turn + 1, -1, nobody)),
    )
    base = (
        files.where(F.col("content_id").isNotNull())
        .groupBy("content_id")
        .agg(F.count("*").alias("_delta"))
        .select("content_id", F.lit(-1).cast("long").alias("_at"), "_delta")
    )
    # An inline struct array keeps this one pass over the batch, whatever number of rows it yields.
    timeline = moves.select(F.inline(F.array_compact(events))).unionByName(base, allowMissingColumns=True)
    counted = sum_before(timeline, "content_id", "_at", "_delta", "_files", 2 * rows_per_chunk)
    return counted.where(F.col("ord").isNotNull()).select("ord", (F.col("_files") > 0).alias("has_files"))


def classify(
    batch: DataFrame,
    files: DataFrame,
    always_original: Column,
    similar: Column | None = None,
    rows_per_chunk: int = settings.ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``image_type``: SIMILAR where told, ORIGINAL where told or where the content has no
    file at that turn, DUPLICATE otherwise."""
    seen = has_files_before(batch, files, rows_per_chunk)
    kind = F.when(always_original, "ORIGINAL").when(F.col("has_files"), "DUPLICATE").otherwise("ORIGINAL")
    if similar is not None:
        kind = F.when(similar, "SIMILAR").otherwise(kind)
    return batch.join(seen, "ord").withColumn("image_type", kind).drop("has_files")


def upsert_files(files: DataFrame, batch: DataFrame, new_id: Column | None = None) -> DataFrame:
    """New state of the file rows, one per path.

    ``batch``: ``path``, ``sha256_hex``, ``file_size``, ``disk_mtime``, ``image_type``,
    ``content_id``, ``parent_folder_id``, ``discovered_at`` and, for new rows, ``id``. A known
    path with the same content gets size and time only; with another content also hash, type and
    content. The folder of a known path never changes.
    """
    new = batch.select(
        F.col("path").alias("_path"),
        (F.col("id") if new_id is None else new_id).alias("_id"),
        *[
            F.col(c).alias(f"_{c}")
            for c in (
                "sha256_hex", "file_size", "disk_mtime", "image_type", "content_id",
                "parent_folder_id", "discovered_at",
            )
        ],
    )
    is_new = F.col("local_path").isNull()
    untouched = F.col("_path").isNull()
    same = F.col("content_id").eqNullSafe(F.col("_content_id"))

    def refreshed(column):
        return F.when(untouched, F.col(column)).otherwise(F.col(f"_{column}")).alias(column)

    def repointed(column):
        return F.when(untouched | (~is_new & same), F.col(column)).otherwise(F.col(f"_{column}")).alias(column)

    def kept(column):
        return F.when(is_new, F.col(f"_{column}")).otherwise(F.col(column)).alias(column)

    return files.join(new, F.col("local_path") == F.col("_path"), "full_outer").select(
        kept("id"),
        F.coalesce("local_path", "_path").alias("local_path"),
        repointed("sha256_hex"),
        refreshed("file_size"),
        kept("discovered_at"),
        refreshed("disk_mtime"),
        F.when(untouched, F.col("present_locally")).otherwise(True).alias("present_locally"),
        repointed("image_type"),
        repointed("content_id"),
        kept("parent_folder_id"),
    )


def compare(
    a: DataFrame, b: DataFrame, threshold: int | None = None, **options
) -> DataFrame:
    """Pictures of ``a`` that ``b`` does not hold, by content and not by name.

    Both have ``path``, ``sha256_hex`` and ``bits``. Exact copies go first, so only the rest is
    compared by perceptual hash.
    """
    from shoebox.operators.hamming_join import candidates

    threshold = settings.NEAR_THRESHOLD if threshold is None else threshold
    rest = a.join(b.select("sha256_hex").distinct(), "sha256_hex", "left_anti")
    left = rest.select(F.col("bits").alias("_bits")).distinct()
    right = b.select(F.col("bits").alias("_ibits")).distinct()
    near = candidates(left, right, "_bits", "_ibits", threshold, **options)
    near = near.groupBy("_bits").agg(F.min("distance").alias("_d"))
    return rest.join(near, F.col("bits") == F.col("_bits"), "left_anti")
