"""Ledger of large objects that are stored in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.operators.filters import resumable


def plan_parts(
    objects: DataFrame,
    size: str = "total_size",
    limit: int = settings.SINGLE_PUT_LIMIT,
    part_size: int = settings.PART_SIZE,
) -> DataFrame:
    """One row per part of every object larger than ``limit``: number from 1, offset and size."""
    count = F.ceil(F.col(size) / F.lit(part_size)).cast("int")
    numbered = objects.where(F.col(size) > limit).withColumn(
        "part_number", F.explode(F.sequence(F.lit(1), count))
    )
    offset = (F.col("part_number").cast("long") - 1) * part_size
    return numbered.withColumn("part_offset", offset).withColumn(
        "part_size", F.least(F.lit(part_size).cast("long"), F.col(size).cast("long") - F.col("part_offset"))
    )


def pending_parts(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned parts still to be sent, with the ledger row to reuse if there is one.

    ``plan`` has ``upload_row_id`` and ``part_number``. A part is done when any of its ledger
    rows is UPLOADED; of several unfinished rows the last one is reused.
    """
    state = ledger.groupBy("upload_row_id", "part_number").agg(
        F.max(F.col("upload_status") == "UPLOADED").alias("_done"), F.max("id").alias("ledger_id")
    )
    left = plan.join(state, ["upload_row_id", "part_number"], "left")
    return left.where(~F.coalesce("_done", F.lit(False))).drop("_done")


def manifests(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Uploads whose planned parts are all done, with their (number, etag) list in order."""
    done = (
        ledger.where(F.col("upload_status") == "UPLOADED")
        .groupBy("upload_row_id", "part_number")
        .agg(F.max("part_etag").alias("part_etag"))
    )
    checked = plan.select("upload_row_id", "part_number").join(
        done.withColumn("_done", F.lit(1)), ["upload_row_id", "part_number"], "left"
    )
    # The list is as long as the object has parts, which the plan bounds.
    grouped = checked.groupBy("upload_row_id").agg(
        F.count("*").alias("parts"),
        F.count("_done").alias("_done"),
        F.array_sort(F.collect_list(F.struct("part_number", "part_etag"))).alias("manifest"),
    )
    return grouped.where(F.col("parts") == F.col("_done")).drop("_done")


def resume_decisions(contents: DataFrame, uploads: DataFrame, as_of: Column) -> DataFrame:
    """Per content: ``done``, ``resume`` an upload, or start ``fresh``.

    Only uploads younger than the resume window count; of several the smallest id is taken.
    """
    young = uploads.where(resumable("initiated_at", as_of))
    chosen = young.groupBy("content_id").agg(F.min("id").alias("id"))
    chosen = young.join(chosen.select("id"), "id", "left_semi").select(
        "content_id", F.col("id").alias("upload_row_id"), "upload_id", "status"
    )
    decision = (
        F.when(F.col("upload_row_id").isNull(), "fresh")
        .when(F.col("status") == "UPLOADED", "done")
        .when(F.col("upload_id").isNull(), "fresh")
        .otherwise("resume")
    )
    joined = contents.select("content_id").join(chosen, "content_id", "left")
    reused = F.col("decision") != "fresh"
    return joined.withColumn("decision", decision).select(
        "content_id",
        "decision",
        F.when(reused, F.col("upload_row_id")).alias("upload_row_id"),
        F.when(reused, F.col("upload_id")).alias("upload_id"),
    )


def reconcile(listed: DataFrame, uploads: DataFrame) -> DataFrame:
    """Compare uploads the store lists (``upload_id``) with recorded ones.

    Unknown here: abort. Known on both sides and unfinished: resume. Recorded only: start again
    if unfinished. Finished ones need nothing.
    """
    a = listed.select("upload_id").distinct().withColumn("_listed", F.lit(True))
    b = uploads.where(F.col("upload_id").isNotNull()).select("upload_id", "id", "status")
    action = (
        F.when(F.col("id").isNull(), "abort")
        .when(F.col("status") == "UPLOADED", "none")
        .when(F.col("_listed").isNull(), "restart")
        .otherwise("resume")
    )
    return a.join(b, "upload_id", "full_outer").select(
        "upload_id", F.col("id").alias("upload_row_id"), action.alias("action")
    )
