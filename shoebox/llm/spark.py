"""What the operators share on Spark's side: folders, splits of documents, lookups that stand hot keys."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.session import durable, shared_dir

HOT_SHARE = 1024
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES``, not only at a count of rows: a task and its worker hold that much text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, kind: str, make: bool = False) -> str:
    """A new folder below the shared one, as a URI that tasks open by pyarrow's file systems."""
    base = shared_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    folder = f"{base}/shoebox/{kind}-{uuid.uuid4().hex}"
    if make:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
    return folder


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of many rows with one row per key, where ``right[rows]`` counts the left rows of the key.

    A key with more than 1/HOT_SHARE of all left rows is broadcast: there are fewer than HOT_SHARE such keys,
    whatever the input. The others are joined by a shuffle in which no key is large.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_SHARE > F.lit(total)
    few = F.broadcast(right.where(hot).drop(rows))
    rest = left.join(few.select(key), key, "left_anti").join(right.where(~hot).drop(rows), key)
    return left.join(few, key).unionByName(rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of (doc_id, text, label), those with the least hash of the id, one per id.

    Ids are chosen first, from short rows; the chosen ones are broadcast (``limit`` bounds them), so no text is shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int"))
    known = known.groupBy("doc_id").agg(F.max(label).alias(label)).join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    return durable(rows.dropDuplicates(["doc_id"]))
