"""Durable intermediate tables.

Iterative operators cut their lineage with a table written to the folder the cluster names in
``spark.checkpoint.dir``. A lost executor then costs a re-read, not a re-run of every round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a fresh folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shoebox-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    target = f"{shared_dir(df.sparkSession)}/shoebox/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def dense_order(df: DataFrame, *columns, name: str = "ord", start: int = 0) -> DataFrame:
    """Number the rows start, start+1, ... in the order of ``columns`` without a one-task window.

    A range-partitioned sort gives every row its place inside its partition; the offsets of the
    partitions come from one count per partition, so the only broadcast side has as many rows
    as there are shuffle partitions.
    """
    spark = df.sparkSession
    row_bits = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
    ranged = durable(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    block = F.shiftright("_row", row_bits)
    sizes = ranged.groupBy(block.alias("_block")).agg(F.count("*").alias("_size")).collect()
    offset, offsets = start, []
    for row in sorted(sizes, key=lambda r: r["_block"]):
        offsets.append((row["_block"], offset))
        offset += row["_size"]
    if not offsets:
        return ranged.withColumn(name, F.col("_row")).drop("_row")
    table = spark.createDataFrame(offsets, "_block long, _offset long")
    return (
        ranged.withColumn("_block", block)
        .join(F.broadcast(table), "_block")
        .withColumn(name, F.col("_offset") + F.col("_row").bitwiseAND(F.lit((1 << row_bits) - 1)))
        .drop("_block", "_offset", "_row")
    )
