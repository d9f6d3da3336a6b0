"""The part of a large stored table that a batch touches, without moving the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 100_000  # keys that are broadcast, counted first; more are met by an ordinary join


def narrowed(stored: DataFrame, keys: DataFrame, column: str, few: int = FEW, outside: bool = False) -> DataFrame:
    """Rows of ``stored`` whose ``column`` is in ``keys`` (one column of that name, a durable table), or is not.

    Few keys are broadcast, so the stored rows are filtered where they are read.
    """
    keys = keys.select(column).where(F.col(column).isNotNull()).distinct()
    if keys.limit(few + 1).count() <= few:
        keys = F.broadcast(keys)
    return stored.join(keys, column, "left_anti" if outside else "left_semi")
