"""Documents to packed training sequences in five stages, each a table that the next one reads.

1. ``language``: documents without a recognised language go (no letter, or less than ``LEAST_SCORE`` like any profile).
2. ``near_duplicates``: one document of each SimHash component stays, the one with the least id.
3. ``repeated_passages``: byte strings that an earlier document has are taken out; a document of which nothing is left goes.
4. ``contamination``: documents that hold benchmark items go.
5. ``packing``: what is left is tokenized and packed into sequences.

The first four return the columns of their input, whatever else it holds; a column that has the name of a working
column of an operator is put aside meanwhile. Every stage takes an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import decontam, langid, packing, simhash, suffix_dedup
from shoebox.llm.spark import bounded_batches, crc_fold, lookup, table
from shoebox.session import durable

LEAST_SCORE = 0.05
SHINGLE = 3
DISTANCE = 3
SEQUENCE = 1024
END_ID = 2
FEW_KEYS = 1_000_000  # ids and hashes that are broadcast, 16 bytes each
WORKING = ("lang_pred", "score", "fp", "spans", "leaks", "body", "_id", "_fp", "_body", "root", "component_id")


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of working names renamed, and how to name them back."""
    back = {f"kept_aside_{k}_{c}": c for k, c in enumerate(docs.columns) if c.lower() in WORKING}
    return docs.withColumnsRenamed({c: r for r, c in back.items()}), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, back = _aside(docs)
    columns = docs.columns
    profiles = langid.fit(docs.where(crc_fold("doc_id", 4) != 2))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return langid.predict(docs, profiles).where(known).select(*columns).withColumnsRenamed(back)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose id and text are not among ``keys`` (``_id``, ``_body``); few keys are broadcast, after counting them, so no text moves."""
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_body"])
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, back = _aside(docs)
    columns = docs.columns
    body = F.xxhash64("text").alias("_body")
    marked = durable(simhash.fingerprints(docs.select(F.col("doc_id").alias("_id"), F.col("doc_id").cast("long"), body, "text"), SHINGLE))
    found = durable(simhash.grouped(marked, DISTANCE))
    # One id and text per component stays; the rest are known by theirs. Only short rows are grouped.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_body")).alias("first")
    first = found.groupBy("root").agg(least, F.count("*").alias("rows"))
    judged = lookup(found, first, "root", "rows")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_body") == F.col("first._body"))
    rows = durable(judged.select("_id", "_body", stays.alias("stays")))
    left = _without(docs, durable(rows.where("not stays").select("_id", "_body").distinct()))
    # Rows that repeat id and text are one document.
    twice = durable(rows.where("stays").groupBy("_id", "_body").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not twice.isEmpty():
        again = left.join(twice, left["doc_id"].eqNullSafe(twice["_id"]) & (F.xxhash64("text") == twice["_body"]), "left_semi")
        left = _without(left, twice).unionByName(again.dropDuplicates(["doc_id", "text"]))
    return left.select(*columns).withColumnsRenamed(back)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, back = _aside(docs)
    columns = docs.columns
    rows = suffix_dedup.with_spans(docs, suffix_dedup.spans(docs.select("doc_id", "text")))
    rows = rows.withColumn("text", suffix_dedup.trimmed(F.col("text"), F.col("spans")))
    left = rows.where(F.col("spans").isNull() | (F.length("text") > 0))
    if "n_chars" in columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(size))
    return left.select(*columns).withColumnsRenamed(back)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, back = _aside(docs)
    columns = docs.columns
    marked = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*columns).withColumnsRenamed(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(docs, path, end_id=END_ID, capacity=SEQUENCE), SEQUENCE)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL twin: profiles, fingerprints of whole texts and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
