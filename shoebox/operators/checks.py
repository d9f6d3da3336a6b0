"""Constraint reports: rows that the catalogue must not contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings


def _one_of(column: str, values) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*values)


# What every row of a table must satisfy, by rule name. As in SQL, a CHECK accepts NULL.
RULES = {
    "content": {
        "sha256_hex not null": lambda: F.col("sha256_hex").isNotNull(),
        "phash not null": lambda: F.col("phash").isNotNull(),
        "status not null": lambda: F.col("status").isNotNull(),
        "status domain": lambda: _one_of("status", settings.CONTENT_STATUSES),
    },
    "files": {
        "local_path not null": lambda: F.col("local_path").isNotNull(),
        "sha256_hex not null": lambda: F.col("sha256_hex").isNotNull(),
        "file_size not null": lambda: F.col("file_size").isNotNull(),
        "disk_mtime not null": lambda: F.col("disk_mtime").isNotNull(),
        "present_locally not null": lambda: F.col("present_locally").isNotNull(),
        "image_type domain": lambda: _one_of("image_type", settings.FILE_TYPES),
    },
    "synced_folders": {"parent_folder_path not null": lambda: F.col("parent_folder_path").isNotNull()},
    "uploads": {
        "status not null": lambda: F.col("status").isNotNull(),
        "total_size not null": lambda: F.col("total_size").isNotNull(),
        "status domain": lambda: _one_of("status", settings.UPLOAD_STATUSES),
    },
    "upload_parts": {
        "upload_row_id not null": lambda: F.col("upload_row_id").isNotNull(),
        "upload_status not null": lambda: F.col("upload_status").isNotNull(),
        "upload_status domain": lambda: _one_of("upload_status", settings.UPLOAD_STATUSES),
    },
}
UNIQUE = {
    "content": "sha256_hex",
    "files": "local_path",
    "synced_folders": "parent_folder_path",
    "uploads": "upload_id",
}
REFERENCES = {
    "files": (("content_id", "content"), ("parent_folder_id", "synced_folders")),
    "uploads": (("content_id", "content"),),
    "upload_parts": (("upload_row_id", "uploads"),),
}


def check_violations(rows: DataFrame, table: str) -> DataFrame:
    """One row (``id``, ``rule``) per broken row rule, in a single pass without a shuffle."""
    broken = F.array_compact(
        F.array(*[F.when(~holds(), F.lit(rule)) for rule, holds in RULES[table].items()])
    )
    return rows.select("id", F.explode(broken).alias("rule"))


def unique_violations(rows: DataFrame, table: str) -> DataFrame:
    """Values of the table's unique column that occur more than once."""
    column = UNIQUE[table]
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def fk_violations(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose non-NULL ``column`` names no parent ``id``."""
    keys = parents.select(F.col("id").alias("_parent"))
    return rows.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def release_missing(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """ON DELETE SET NULL: clear references to parents that are gone."""
    keys = parents.select(F.col("id").alias("_parent"))
    joined = rows.join(keys, F.col(column) == F.col("_parent"), "left")
    return joined.withColumn(column, F.col("_parent")).drop("_parent").select(*rows.columns)
