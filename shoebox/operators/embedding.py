"""Embedding step: which contents need a vector, how they get it, what their status becomes.

An encoder is given as a factory: a picklable callable without arguments that loads the model and
returns ``encode(list_of_inputs) -> array of shape (n, dimensions)``. Each task calls it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.operators.filters import needs_embedding
from shoebox.operators.lifecycle import after_embedding

Encoder = Callable[[list], np.ndarray]
ENCODED = "vector array<float>, error string"


def encode_each(encode: Encoder, inputs: list) -> tuple[list, list]:
    """Encode a batch at once; if that fails, row by row, so one bad input spoils only itself."""
    try:
        rows = np.asarray(encode(inputs), dtype=np.float32)
        if len(rows) == len(inputs):
            return list(rows), [None] * len(rows)
    except Exception:  # noqa: BLE001 - any model error becomes a row outcome below
        pass
    vectors, errors = [], []
    for one in inputs:
        try:
            vectors.append(np.asarray(encode([one])[0], dtype=np.float32))
            errors.append(None)
        except Exception as problem:  # noqa: BLE001
            vectors.append(None)
            errors.append(f"{type(problem).__name__}: {problem}")
    return vectors, errors


def encode_udf(factory: Callable[[], Encoder]):
    """Column function giving ``struct<vector, error>`` for a column of inputs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            present = batch.notna().to_numpy()
            vectors: list = [None] * len(batch)
            errors: list = [None if p else "no input" for p in present]
            got, failed = encode_each(encode, [v for v, p in zip(batch, present) if p])
            for place, vector, error in zip(np.flatnonzero(present), got, failed):
                vectors[place], errors[place] = vector, error
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ENCODED)


def embed_queries(queries: DataFrame, factory: Callable[[], Encoder], text: str = "text") -> DataFrame:
    """Add ``embedding`` to rows of query text; a failing encoder fails the query."""
    encoded = encode_udf(factory)(F.col(text))
    checked = F.when(
        F.col("_e.error").isNotNull(), F.raise_error(F.col("_e.error")).cast("array<float>")
    ).otherwise(F.col("_e.vector"))
    return queries.withColumn("_e", encoded).withColumn("embedding", checked).drop("_e")


def embed_update(
    content: DataFrame,
    factory: Callable[[], Encoder],
    payload: str | Column = "payload",
    force: bool = False,
) -> DataFrame:
    """New ``status`` and ``embedding`` of contents with ``id``, ``status``, ``embedding``, payload.

    Only rows that need a vector reach the encoder; success gives INDEXED, failure ERROR and
    keeps whatever vector there was. Adds ``embed_error``.
    """
    wanted = needs_embedding(force=force)
    payload = F.col(payload) if isinstance(payload, str) else payload
    # The filter comes before the encoder: inside one expression both sides would be evaluated.
    todo = content.where(wanted).withColumn("_e", encode_udf(factory)(payload))
    encoded = F.col("_e.vector").isNotNull()
    done = todo.withColumn("status", after_embedding(F.col("status"), F.lit(True), encoded)).withColumn(
        "embedding", F.coalesce(F.col("_e.vector"), F.col("embedding"))
    )
    rest = content.where(~wanted).withColumn("embed_error", F.lit(None).cast("string"))
    return done.withColumn("embed_error", F.col("_e.error")).drop("_e").unionByName(rest)
