"""What happens to each file of a batch: which content it ends at, and what must be stored.

The files of a batch are put in one order: first the files that resume an interrupted store, then
all others by path. Every rule below then equals a one-by-one run in that order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.bits import hex_to_bits
from shoebox.operators import exact, near_dup
from shoebox.operators.filters import is_stored
from shoebox.operators.narrow import narrowed
from shoebox.session import dense_order, durable


@dataclass
class Decisions:
    files: DataFrame  # one row per file: ord, facts, content_id, is_similar, is_first
    to_store: DataFrame  # contents whose bytes must be stored: id, facts of their first file, is_new


def in_order(facts: DataFrame, content: DataFrame) -> DataFrame:
    """Number the files of a batch and attach what the catalogue knows about their hash."""
    known = exact.lookup_stored(facts, content)
    waiting = F.col("content_id").isNotNull() & ~is_stored("content_status")
    resumed = (
        known.where(waiting).groupBy("sha256_hex").agg(F.min("path").alias("path")).select(
            "path", F.lit(0).alias("_turn")
        )
    )
    turned = known.join(resumed, "path", "left").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    return (
        dense_order(turned, "_turn", "path")
        .withColumn("bits", hex_to_bits("phash"))
        .withColumn("resumes", F.col("_turn") == 0)
        .drop("_turn")
    )


def decide(
    facts: DataFrame,
    content: DataFrame,
    policy: str = settings.DEFAULT_POLICY,
    threshold: int = settings.NEAR_THRESHOLD,
    near: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> Decisions:
    """Exact lookup first, near match only for the rest; new ids follow the order of arrival.

    ``facts`` is a durable table. ``near`` names the stored contents (``id``) near any of given ``bits``, as a durable
    table; without it all are compared.
    """
    known = durable(narrowed(content, facts, "sha256_hex"))
    rows = in_order(facts, known)
    last_id = content.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    unknown = rows.where(F.col("content_id").isNull())
    first = unknown.groupBy("sha256_hex").agg(F.min("ord").alias("ord")).select("ord")
    fresh = unknown.join(first, "ord", "left_semi")
    similar = None
    if policy == "discard":
        fresh = durable(fresh)
        # Contents resumed in this batch come first in the order, so they count as stored here.
        resumed = rows.where("resumes").select(F.col("content_id").alias("id"))
        around = content if near is None else narrowed(content, near(durable(unknown.select("bits").distinct())), "id")
        held = around.where(is_stored()).select("id", "phash").unionByName(
            known.join(resumed, "id", "left_semi").select("id", "phash")
        )
        stored = held.groupBy(hex_to_bits("phash").alias("bits")).agg(
            (F.min("id") - F.lit(last_id + 1)).alias("ord"), F.max("id").alias("content_id")
        )
        stored = durable(stored)
        arriving = (
            fresh.groupBy("bits").agg(F.min("ord").alias("ord")).join(stored, "bits", "left_anti")
        )
        kept = near_dup.keep_in_order(stored, durable(arriving), threshold, **options)
        fresh = fresh.join(kept.select("ord"), "ord", "left_semi")
    fresh = dense_order(fresh, "ord", name="id", start=last_id + 1)
    if policy == "discard":
        index = stored.unionByName(fresh.select("bits", "ord", F.col("id").alias("content_id")))
        others = unknown.join(fresh.select("sha256_hex"), "sha256_hex", "left_anti")
        similar = near_dup.assign_similar(others, index, threshold, **options).select(
            "ord", F.col("content_id").alias("_similar_id")
        )
    named = fresh.select("sha256_hex", F.col("id").alias("_new_id"), F.col("ord").alias("_first_ord"))
    files = rows.join(named, "sha256_hex", "left")
    if similar is None:
        files = files.withColumn("_similar_id", F.lit(None).cast("long"))
    else:
        files = files.join(similar, "ord", "left")
    files = durable(
        files.withColumn("content_id", F.coalesce("content_id", "_new_id", "_similar_id"))
        .withColumn("is_similar", F.col("_similar_id").isNotNull())
        .withColumn("is_first", F.col("resumes") | F.coalesce(F.col("_first_ord") == F.col("ord"), F.lit(False)))
        .drop("_new_id", "_first_ord", "_similar_id")
    )
    facts_columns = ["sha256_hex", "phash", "bits", "path", "file_size", "mime", "ord"]
    to_store = fresh.select("id", *facts_columns, F.lit(True).alias("is_new")).unionByName(
        rows.where("resumes").select(F.col("content_id").alias("id"), *facts_columns, F.lit(False).alias("is_new"))
    )
    return Decisions(files, to_store)
