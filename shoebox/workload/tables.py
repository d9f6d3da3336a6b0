"""Library tables derived from the driver's parquet tables.

The driver holds no pictures, so documents play the payloads: bytes are the UTF-8 text, and the
gray picture that the perceptual hash sees is the 32 x 32 histogram of all four-character windows
of the whole text. Copies and small edits of a text then give equal and near hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.functions import paths
from shoebox.functions.bits import hex_to_bits
from shoebox.functions.pixels import SIDE, phash_of_gray

# The window code of characters a, b, c, d is
# (((a * BASE + b) * BASE + c) * BASE + d) mod PRIME mod SIDE*SIDE.
BASE, PRIME, WINDOW = 131, 1_048_573, 4
PICTURES = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer splits than cores, as with one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def window_picture(text: pd.Series) -> pd.Series:
    weights = [BASE**i for i in range(WINDOW - 1, -1, -1)]

    def one(value: str) -> np.ndarray:
        codes = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if len(codes) < WINDOW:
            return np.zeros(SIDE * SIDE)
        last = len(codes) - WINDOW + 1
        window = sum(w * codes[i : i + last] for i, w in enumerate(weights))
        return np.bincount(window % PRIME % (SIDE * SIDE), minlength=SIDE * SIDE).astype(np.float64)

    return pd.Series([one(v) for v in text])


@F.pandas_udf(T.StringType())
def text_phash(text: pd.Series) -> pd.Series:
    """Perceptual hash of each text's picture; a task holds ``PICTURES`` pictures of 8 KB, not those of its whole Arrow batch."""
    parts = [phash_of_gray.func(window_picture.func(text.iloc[k : k + PICTURES])) for k in range(0, len(text), PICTURES)]
    return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)


def document_path():
    """/lib/<source>/<lang>/<doc_id><extension>; the language names the file type."""
    ext = (
        F.when(F.col("lang") == "en", ".jpg")
        .when(F.col("lang") == "de", ".PNG")
        .when(F.col("lang") == "fr", ".Tif")
        .otherwise(".txt")
    )
    return F.concat(
        F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext
    )


def document_sha():
    return F.sha2(F.col("text").cast("binary"), 256)


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as scanned files: ord, path, sha256_hex, file_size, lang, source."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        document_path().alias("path"),
        document_sha().alias("sha256_hex"),
        F.octet_length("text").cast("long").alias("file_size"),
        "lang",
        "source",
    )


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned files with their perceptual hash: ord, sha256_hex, phash, bits, lang."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    hashed = docs.select(
        F.col("doc_id").alias("ord"),
        "lang",
        document_sha().alias("sha256_hex"),
        text_phash("text").alias("phash"),
    )
    return hashed.withColumn("bits", hex_to_bits("phash"))


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct payload: id of its first file, bits, number of copies."""
    return (
        pictures(spark, sf)
        .groupBy("sha256_hex")
        .agg(F.min("ord").alias("id"), F.min("bits").alias("bits"), F.count("*").alias("copies"))
    )


def orders_as_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("uploaded_bytes"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("dup_group"),
        F.when(F.col("o_orderstatus") == "O", "INDEXED")
        .when(F.col("o_orderstatus") == "F", "UPLOADED")
        .otherwise("ERROR")
        .alias("status"),
    )


def lines_as_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("content_id"),
        F.when(F.col("l_returnflag") == "A", "DUPLICATE")
        .when(F.col("l_returnflag") == "R", "SIMILAR")
        .otherwise("ORIGINAL")
        .alias("image_type"),
    )


def orders_as_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(
            F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
        ).alias("upload_id"),
        F.col("o_custkey").alias("content_id"),
        F.when(F.col("o_orderstatus") == "F", "UPLOADED")
        .when(F.col("o_orderstatus") == "P", "PENDING")
        .otherwise("UPLOADING")
        .alias("status"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("total_size"),
        F.col("o_orderdate").alias("initiated_at"),
    )


def lines_as_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.col("l_orderkey").alias("upload_row_id"),
        F.col("l_linenumber").alias("part_number"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("part_etag"),
        F.when(F.col("l_linestatus") == "F", "UPLOADED").otherwise("UPLOADING").alias("upload_status"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as file changes: one path per user and kind, content named by the whole value."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jpg")).alias("path"),
        F.col("ts").alias("disk_mtime"),
        F.floor("value").cast("long").alias("content_id"),
        "value",
        "event_type",
    )


def first_and_last(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The library before (first change of every path) and a batch (last change, if another)."""
    rows = changes(spark, sf)
    ends = rows.groupBy("path").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    before = rows.join(ends.select(F.col("_first").alias("ord")), "ord", "left_semi")
    batch = rows.join(ends.where("_first < _last").select(F.col("_last").alias("ord")), "ord", "left_semi")
    return before, batch


def as_file_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("ord").alias("id"),
        F.col("path").alias("local_path"),
        F.concat(F.lit("sha-"), F.col("content_id").cast("string")).alias("sha256_hex"),
        F.floor(F.col("value") * 100).cast("long").alias("file_size"),
        F.col("disk_mtime").alias("discovered_at"),
        "disk_mtime",
        F.lit(True).alias("present_locally"),
        F.lit("ORIGINAL").alias("image_type"),
        "content_id",
        F.lit(None).cast("long").alias("parent_folder_id"),
    )


def labelled_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a processing state from their labels and the vector of the same number."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    status = (
        F.when(F.col("quality").isNull(), "UPLOADED")
        .when(F.col("toxic") == 1, "ERROR")
        .when(F.col("quality") == 1, "INDEXED")
        .otherwise("INDEXING")
    )
    return (
        table(spark, sf, "documents")
        .select("doc_id", "text")
        .join(labels, "doc_id", "left")
        .join(vectors, "doc_id", "left")
        .select(F.col("doc_id").alias("id"), status.alias("status"), "embedding", "text")
    )


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))


def page_folder_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct scheme://host and scheme://host/<first segment> of all pages."""
    urls = page_paths(spark, sf)
    levels = F.array(
        F.regexp_extract("path", r"^([a-z]+://[^/]+)", 1), F.regexp_extract("path", r"^([a-z]+://[^/]+/[^/]+)", 1)
    )
    return urls.select(F.explode(levels).alias("path")).where("path <> ''").distinct()


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("photos/"), F.col("vec_id").cast("string")).alias("s3_path"),
        "embedding",
        "label",
    )
