"""Content-addressed object store: one object per content hash, written by the tasks.

An object is written under a temporary name and moved to its key, and the key is the hash of the
bytes, so a repeated or speculative task can only write the same object again.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shoebox.sources.facts import BLOCK, by_bytes
from shoebox.sources.storage import locate


def _put(target: str, chunks: Iterator[bytes]) -> None:
    system, path = locate(target)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft) as out:
            for chunk in chunks:
                out.write(chunk)
        system.move(draft, path)
    except BaseException:
        if system.get_file_info(draft).is_file:
            system.delete_file(draft)
        raise


def _chunks(uri: str, offset: int = 0, length: int | None = None) -> Iterator[bytes]:
    system, path = locate(uri)
    with system.open_input_file(path) as stream:
        stream.seek(offset)
        left = length
        while left is None or left > 0:
            chunk = stream.read(BLOCK if left is None else min(BLOCK, left))
            if not chunk:
                return
            if left is not None:
                left -= len(chunk)
            yield chunk


def _checked(uri: str, sha: str) -> Iterator[bytes]:
    """The file's bytes; fails at the end if they are no longer the ones that were hashed."""
    seen = hashlib.sha256()
    for chunk in _chunks(uri):
        seen.update(chunk)
        yield chunk
    if seen.hexdigest() != sha:
        raise OSError("file changed while it was stored")


def _per_row(action):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            results, errors = [], []
            for row in rows:
                try:
                    results.append(action(row))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - becomes the row's outcome
                    results.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in rows], pa.int64()),
                    pa.array([r.get("part_number") for r in rows], pa.int32()),
                    pa.array(results, pa.string()),
                    pa.array(errors, pa.string()),
                ],
                names=["id", "part_number", "etag", "error"],
            )

    return run


RESULT = "id long, part_number int, etag string, error string"


def put_objects(rows: DataFrame, store: str) -> DataFrame:
    """Store whole files (``id``, ``path``, ``sha256_hex``, ``object_key``, ``file_size``)."""

    def action(row):
        _put(f"{store}/{row['object_key']}", _checked(row["path"], row["sha256_hex"]))
        return row["sha256_hex"]

    wanted = by_bytes(rows).select("id", "path", "sha256_hex", "object_key")
    return wanted.mapInArrow(_per_row(action), RESULT).drop("part_number")


def put_parts(rows: DataFrame, store: str) -> DataFrame:
    """Store single parts (``id``, ``path``, ``part_number``, ``part_offset``, ``part_size``,
    ``upload_id``); the parts of one large file go to different tasks. Returns their etags."""

    def action(row):
        seen = hashlib.md5()

        def chunks():
            got = 0
            for chunk in _chunks(row["path"], row["part_offset"], row["part_size"]):
                seen.update(chunk)
                got += len(chunk)
                yield chunk
            if got != row["part_size"]:
                raise OSError("file is shorter than planned")

        _put(f"{store}/parts/{row['upload_id']}/{row['part_number']:06d}", chunks())
        return seen.hexdigest()

    dealt = by_bytes(rows, "part_size", ("path", "part_number")).select(
        "id", "path", "part_number", "part_offset", "part_size", "upload_id"
    )
    return dealt.mapInArrow(_per_row(action), RESULT)


def complete_objects(rows: DataFrame, store: str) -> DataFrame:
    """Join the stored parts of finished uploads (``id``, ``path``, ``upload_id``, ``parts``,
    ``sha256_hex``, ``object_key``, ``file_size``) to one object, checked against its hash."""

    def action(row):
        seen = hashlib.sha256()

        def chunks():
            for number in range(1, row["parts"] + 1):
                for chunk in _chunks(f"{store}/parts/{row['upload_id']}/{number:06d}"):
                    seen.update(chunk)
                    yield chunk
            if seen.hexdigest() != row["sha256_hex"]:
                raise OSError("parts do not add up to the hashed file")

        _put(f"{store}/{row['object_key']}", chunks())
        return row["sha256_hex"]

    wanted = by_bytes(rows).select("id", "path", "upload_id", "parts", "sha256_hex", "object_key")
    return wanted.mapInArrow(_per_row(action), RESULT).drop("part_number")
