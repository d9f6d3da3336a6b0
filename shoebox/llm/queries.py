"""The registered queries: each operator with its production parameters over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import (
    automaton_dedup, collocations, decontam, kneser_ney, langid, lexical_search, oracle, packing, quality_rules, simhash, site_quality, suffix_dedup,
    token_files, toxicity,
)
from shoebox.llm.spark import crc_fold, table

TOKENIZER = "byte_bpe_50k.json"


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a model learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 10) == 0).alias("held_out"))
    return kneser_ney.score(docs, kneser_ney.fit(docs.where(~F.col("held_out"))))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, sources as hosts and languages as their paths; a fifth of the labels is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0)
    return site_quality.score(docs, labels, site_quality.fit(docs, labels))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as Simple-8b token files in id order and read the files back."""
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)
    return token_files.read(spark, files)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure all documents and judge them by the thresholds of their language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents by profiles learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_fold("doc_id", 4) == 2).alias("held_out"))
    profiles = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), profiles).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, capacity=1024)
    return packing.pack(cut, 1024)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte strings of earlier documents leave of each of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.with_spans(docs, suffix_dedup.spans(docs)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"),
        F.coalesce(F.array_max("leaks.share"), F.lit(0.0)).alias("share"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by nearest labelled examples from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 3) == 1).alias("held_out"))
    index = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, index)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of links of at most three bits."""
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op11_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 13-word windows of earlier documents leave of each of all documents."""
    docs = table(spark, sf_dir, "documents")
    return automaton_dedup.digest(docs, automaton_dedup.spans(docs))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language, from all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return lexical_search.search(lexical_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney, op2_site_quality, op3_token_files, op4_quality_rules, op5_language_id, op6_best_fit_packing,
        op7_suffix_dedup, op8_decontamination, op9_toxicity, op10_simhash,
        op11_automaton_dedup, op12_collocations, op13_lexical_search,
    )
}
SQL: dict[str, str] = dict(oracle.SQL)
