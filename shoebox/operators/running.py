"""Running values over one key's rows when a single key may hold a large share of the table.

A plain window sorts all rows of a key in one task. Here the order column is cut in stretches of
``ROWS_PER_CHUNK``; each stretch is a window of bounded size, and what came before it is carried
in from one pre-aggregated row per (key, stretch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox import settings


def _chunked(df: DataFrame, order: str, rows: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(rows)).cast("long"))


def sum_before(
    df: DataFrame,
    key: str,
    order: str,
    value: str,
    name: str,
    rows_per_chunk: int = settings.ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the sum of ``value`` over the rows of ``key`` with a strictly smaller ``order``.

    ``order`` is a whole number, dense enough that a stretch of it holds a bounded row count,
    and unique within the key.
    """
    rows = _chunked(df, order, rows_per_chunk)
    carried = (
        rows.groupBy(key, "_chunk")
        .agg(F.sum(value).alias("_part"))
        .withColumn(
            "_carried",
            F.sum("_part").over(
                Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_part")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    local = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_local", local)
        .join(carried, [key, "_chunk"], "left")
        .withColumn(name, F.coalesce("_carried", F.lit(0)) + F.coalesce("_local", F.lit(0)))
        .drop("_chunk", "_local", "_carried")
    )


def last_before(
    df: DataFrame,
    key: str,
    order: str,
    value: str,
    name: str,
    rows_per_chunk: int = settings.ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the latest non-NULL ``value`` of ``key`` with a strictly smaller ``order``."""
    rows = _chunked(df, order, rows_per_chunk)
    carried = (
        rows.where(F.col(value).isNotNull())
        .groupBy(key, "_chunk")
        .agg(F.max_by(value, order).alias("_part"))
    )
    # A stretch without values still needs its predecessor's, so every stretch keeps a row.
    stretches = rows.select(key, "_chunk").distinct().join(carried, [key, "_chunk"], "left")
    carried = stretches.withColumn(
        "_carried",
        F.last("_part", ignorenulls=True).over(
            Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).drop("_part")
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    local = F.last(value, ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_local", local)
        .join(carried, [key, "_chunk"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_chunk", "_local", "_carried")
    )
