"""Status of contents from first sight to searchable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_store(status: Column, stored: Column) -> Column:
    """PENDING, UPLOADING and ERROR rows are stored (again): UPLOADED on success, UPLOADING else."""
    waiting = status.isin("PENDING", "UPLOADING", "ERROR")
    return F.when(waiting, F.when(F.coalesce(stored, F.lit(False)), "UPLOADED").otherwise("UPLOADING")).otherwise(
        status
    )


def after_embedding(status: Column, tried: Column, embedded: Column) -> Column:
    """Stored rows that were given to the encoder become INDEXED, or ERROR when it failed."""
    open_rows = status.isin("UPLOADED", "INDEXING", "INDEXED", "ERROR") & F.coalesce(tried, F.lit(False))
    return F.when(
        open_rows, F.when(F.coalesce(embedded, F.lit(False)), "INDEXED").otherwise("ERROR")
    ).otherwise(status)


def sync_report(outcomes: DataFrame) -> DataFrame:
    """One row of counters from rows with ``outcome``: ingested, skipped or error."""
    return outcomes.agg(
        F.count_if(F.col("outcome") == "ingested").alias("ingested"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
