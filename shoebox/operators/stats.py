"""Library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.filters import is_copy


def saved_bytes(content: DataFrame, files: DataFrame) -> DataFrame:
    """Stored size of the contents that have at least one copy; each content counts once."""
    copied = files.where(is_copy()).groupBy("content_id").agg(F.count("*").alias("copies"))
    owners = content.join(copied, content["id"] == copied["content_id"], "left_semi")
    return owners.agg(F.coalesce(F.sum("uploaded_bytes"), F.lit(0)).alias("saved_bytes"))


def library_stats(content: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total_content, total_files, dupes, stored_bytes, saved_bytes, near_dup_count, indexed."""
    indexed = F.col("status") == "INDEXED"
    parts = [
        content.agg(
            F.count("*").alias("total_content"),
            F.sum(F.when(indexed, F.col("uploaded_bytes"))).alias("stored_bytes"),
            F.count("dup_group").alias("near_dup_count"),
            F.count_if(indexed).alias("indexed"),
        ),
        files.agg(F.count("*").alias("total_files"), F.count_if(is_copy()).alias("dupes")),
        saved_bytes(content, files),
    ]
    names = (
        "total_content", "total_files", "dupes", "stored_bytes", "saved_bytes", "near_dup_count", "indexed",
    )
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def index_stats(content: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: time of the last upload and size of the vector index in bytes (4 per number)."""
    last = content.agg(F.max("uploaded_at").alias("last_upload"))
    size = vectors.agg(F.sum(F.size("embedding").cast("long") * 4).alias("index_bytes"))
    both = last.unionByName(size, allowMissingColumns=True)
    return both.agg(
        F.max("last_upload").alias("last_upload"),
        F.coalesce(F.sum("index_bytes"), F.lit(0)).alias("index_bytes"),
    )
