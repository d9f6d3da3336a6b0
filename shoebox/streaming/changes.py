"""Streams of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.sources.storage import ControlFiles
from shoebox.streaming import state


def drop_repeats(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated notifications of one change: same path, same time of change.

    The watermark runs on the time of arrival: a file's own time may lie years back, and as
    event time it would count as late and vanish. A repeat that arrives after ``delay`` passes,
    and is harmless because the ingest that follows is idempotent.
    """
    arrived = changes.withColumn("_arrived", F.current_timestamp())
    once = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["path", "mtime"])
    return once.drop("_arrived")


def fold_latest(feed: DataFrame, checkpoint: str, order: list[str]) -> DataFrame:
    """Fold what a change feed has by now into one row per path, the last change by ``order``.

    The state is keyed by path and lives with the checkpoint: a run costs what is new in the feed, reading the
    result costs one row per path, whatever number of batches or runs came before.
    """
    spark = feed.sparkSession
    with state.rocksdb(spark):
        run = (
            state.latest_changes(feed, order)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    run.awaitTermination()
    if not [n for n in ControlFiles(spark, checkpoint).names(f"{checkpoint}/commits") if n.isdigit()]:
        return spark.createDataFrame([], feed.schema)
    return state.read_latest(spark, checkpoint, feed.schema)
