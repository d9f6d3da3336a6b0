"""Keyed streaming state on the RocksDB store: the latest change of every path.

State lives with its key: a micro-batch touches the paths it has and no others, a restart goes on from the checkpoint, and reading the whole
state back costs its size, however many batches made it. Keys that hear nothing for ``forget`` are dropped by a timer of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = "path"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own choice is back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class LatestChange(StatefulProcessor):
    """Keeps the last change of a path by ``order`` and passes on what becomes the last one: no repeats, nothing that is overtaken already.

    With ``forget_ms`` a path has one timer, moved whenever the path hears something; at its end the path is forgotten.
    """

    def __init__(self, columns: T.StructType, order: list[str], forget_ms: int | None = None):
        self.columns, self.order, self.forget_ms = columns, order, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.columns)

    def _heard(self, timers) -> None:
        if self.forget_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.forget_ms)

    def _rank(self, row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        best = None if held is None else dict(zip(self.columns.names, held, strict=True))
        newer = False
        for row in rows:
            if best is None or self._rank(row) > self._rank(best):
                best, newer = {c: row[c] for c in self.columns.names}, True
        self._heard(timerValues)
        if newer:
            values = tuple(best[c] for c in self.columns.names)
            self.last.update(values)
            yield Row(**best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(schema: T.StructType) -> T.StructType:
    """The columns as the state holds them: times as microseconds, which compare alike in every time zone."""
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])


def _back(rows: DataFrame, schema: T.StructType) -> DataFrame:
    times = {f.name for f in schema if isinstance(f.dataType, T.TimestampType)}
    return rows.select(*[F.timestamp_micros(f.name).alias(f.name) if f.name in times else f.name for f in schema])


def latest_changes(feed: DataFrame, order: list[str], forget_ms: int | None = None) -> DataFrame:
    """The rows of a stream (``path`` and more) that are their path's last change so far.

    With ``forget_ms`` Spark goes on making batches to look at timers: such a query takes a processing-time trigger.
    """
    processor = LatestChange(_plain(feed.schema), order, forget_ms)
    plain = feed.select(*[F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name for f in feed.schema])
    mode = "None" if forget_ms is None else "ProcessingTime"
    return _back(plain.groupBy(KEY).transformWithState(processor, processor.columns, "Update", mode), feed.schema)


def read_latest(spark: SparkSession, checkpoint: str, columns: T.StructType) -> DataFrame:
    """The state of ``latest_changes`` after the last finished batch: one row per path."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return _back(held.select("value.*"), columns)
