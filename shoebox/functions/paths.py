"""Path, MIME type, key and display columns."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox import settings


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path) -> Column:
    """Lower-case last suffix with its dot; '' for a dot-file, a bare name or a trailing dot."""
    return F.lower(F.regexp_extract(_col(path), r"[^/]+(\.[^./]+)$", 1))


def is_image_path(path) -> Column:
    return extension(path).isin(*settings.IMAGE_EXTENSIONS)


def mime_type(path) -> Column:
    known = {**mimetypes.MimeTypes().types_map[True], **settings.MIME_TYPES}
    # One literal, folded to a constant map when the query is planned.
    pairs = ",".join(f"{ext}:{mime}" for ext, mime in sorted(known.items()))
    table = F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(settings.UNKNOWN_MIME))


def object_key(sha) -> Column:
    return F.concat(F.lit(settings.KEY_PREFIX), _col(sha))


def object_path(bucket, sha) -> Column:
    return F.concat_ws("/", bucket if isinstance(bucket, Column) else F.lit(bucket), object_key(sha))


def folder_title(title, path) -> Column:
    """The given title; a missing or empty one becomes the folder's own name."""
    return F.coalesce(F.nullif(_col(title), F.lit("")), file_name(path))


def human_bytes(size) -> Column:
    """Size with one decimal in B, KB, MB or GB (factor 1024), and in TB beyond.

    Ties such as 1.25 go to the even digit; the JVM formatter alone would round them up.
    """
    value = _col(size).cast("double")
    shown = F.format_string("%.1f TB", F.bround(value / 1024.0**4, 1))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        scaled = value / 1024.0**power
        text = F.format_string(f"%3.1f {unit}", F.bround(scaled, 1))
        shown = F.when(scaled < 1024, text).otherwise(shown)
    return shown


def result_line(score, content_id, path) -> Column:
    return F.format_string("%.2f %d %s", _col(score), _col(content_id), _col(path))


def local_path(uri) -> Column:
    """Drop the ``file:`` scheme, which sources spell as ``file:/x`` or ``file:///x``."""
    return F.regexp_replace(_col(uri), r"^file:/+", "/")
