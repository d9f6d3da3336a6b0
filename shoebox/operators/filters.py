"""Row predicates on catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.paths import is_image_path


def images_only(scan: DataFrame, path: str = "path") -> DataFrame:
    return scan.where(is_image_path(path))


def is_stored(status="status") -> Column:
    """Contents whose bytes are safe: they take part in de-duplication."""
    return F.col(status).isin(*settings.STORED_STATUSES)


def needs_embedding(status="status", vector="embedding", force: bool = False) -> Column:
    if force:
        return F.lit(True)
    done = (F.col(status) == "INDEXED") & F.col(vector).isNotNull()
    return ~F.coalesce(done, F.lit(False))


def unfinished(content: DataFrame) -> DataFrame:
    """Contents a restart has to pick up again."""
    return content.where(F.col("status") != "INDEXED")


def is_copy(image_type="image_type") -> Column:
    return F.col(image_type).isin("DUPLICATE", "SIMILAR")


def check_policy(policy: str | None) -> str:
    policy = policy or settings.DEFAULT_POLICY
    if policy not in settings.POLICIES:
        raise ValueError(f"policy is one of {', '.join(sorted(settings.POLICIES))}, not {policy}")
    return policy


def resumable(initiated_at: str, as_of: Column) -> Column:
    """Strictly younger than the resume window."""
    return F.col(initiated_at) > as_of - F.expr(f"INTERVAL {settings.RESUME_DAYS} DAYS")
