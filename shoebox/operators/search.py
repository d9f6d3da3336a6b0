"""Top-k vector search.

Scores come from one matrix product per Arrow batch. Each task keeps only its best k rows per
query, so what is shuffled or sent to the driver never grows with the table. Scores are rounded
to ``SCORE_DECIMALS`` before ranking: ties then fall to the smaller id however the rows are
split into batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox import settings

SCORE_DECIMALS = 9
RESULT = "query_id long, score double, id long, s3_path string"


class _Best:
    """The k best rows per query seen so far in one task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray, list]] = [
            (np.empty(0), np.empty(0, dtype=np.int64), []) for _ in queries
        ]

    def add(self, ids: np.ndarray, paths: pa.Array, matrix: np.ndarray) -> None:
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.round((self.queries @ matrix.T) / norms, SCORE_DECIMALS)
        # Rows without a direction have no score and take no place among the k.
        scores = np.where(np.isnan(scores), -np.inf, scores)
        for q, row in enumerate(scores):
            old_scores, old_ids, old_paths = self.rows[q]
            floor = old_scores[-1] if len(old_scores) == self.k else -np.inf
            if len(row) > self.k:
                floor = max(floor, np.partition(row, len(row) - self.k)[len(row) - self.k])
            picked = np.flatnonzero((row >= floor) & (row > -np.inf))
            all_scores = np.concatenate([old_scores, row[picked]])
            all_ids = np.concatenate([old_ids, ids[picked]])
            all_paths = old_paths + paths.take(pa.array(picked)).to_pylist()
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.rows[q] = (all_scores[order], all_ids[order], [all_paths[i] for i in order])

    def result(self, query_ids: Sequence[int]) -> pa.RecordBatch:
        sizes = [len(scores) for scores, _, _ in self.rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.asarray(query_ids, dtype=np.int64), sizes)),
                pa.array(np.concatenate([scores for scores, _, _ in self.rows])),
                pa.array(np.concatenate([ids for _, ids, _ in self.rows])),
                pa.array([p for _, _, paths in self.rows for p in paths], type=pa.string()),
            ],
            names=["query_id", "score", "id", "s3_path"],
        )


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _local_best(vectors: DataFrame, query_ids: Sequence[int], queries: np.ndarray, k: int) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((list(query_ids), _unit_rows(queries)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        best = _Best(units, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = flat.reshape(batch.num_rows, units.shape[1])
            best.add(batch.column(0).to_numpy(), batch.column(1), matrix)
        yield best.result(ids)

    index = vectors.where(F.col("embedding").isNotNull()).select(
        F.col("id").cast("long").alias("id"), "s3_path", "embedding"
    )
    return index.mapInArrow(scan, RESULT)


def search(
    vectors: DataFrame,
    query_vector: Sequence[float],
    k: int = settings.TOP_K,
    threshold: float | None = settings.SIMILARITY_FLOOR,
) -> DataFrame:
    """The k nearest contents by cosine, best first, then cut at ``threshold`` (inclusive).

    ``vectors`` has ``id``, ``s3_path`` and ``embedding``. Returns ``score``, ``id``, ``s3_path``.
    """
    local = _local_best(vectors, [0], np.asarray([list(query_vector)]), k)
    top = local.select("score", "id", "s3_path").orderBy(F.desc("score"), "id").limit(k)
    return top if threshold is None else top.where(F.col("score") >= threshold)


def search_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = settings.TOP_K,
    threshold: float | None = settings.SIMILARITY_FLOOR,
    limit_bytes: int = settings.BROADCAST_BYTES,
) -> DataFrame:
    """``search`` for every row of ``queries`` (``query_id``, ``embedding``).

    Queries are shipped in slices whose size is checked; each slice reads the vectors once.
    Returns ``query_id``, ``score``, ``id``, ``s3_path``.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], RESULT)
    slices = -(-size["n"] * (size["d"] or 1) * 8 // limit_bytes)
    best = None
    for i in range(slices):
        part = queries.select("query_id", "embedding")
        if slices > 1:
            part = part.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        rows = part.collect()
        if not rows:
            continue
        local = _local_best(
            vectors, [r["query_id"] for r in rows], np.asarray([r["embedding"] for r in rows]), k
        )
        best = local if best is None else best.unionByName(local)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = best.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    return top if threshold is None else top.where(F.col("score") >= threshold)


def more_like_this(vectors: DataFrame, content_id: int, k: int = settings.TOP_K) -> DataFrame:
    """Nearest stored pictures of one stored picture, itself excluded."""
    own = vectors.where((F.col("id") == content_id) & F.col("embedding").isNotNull())
    row = own.select("embedding").first()
    if row is None:
        raise ValueError(f"content {content_id} has no vector")
    return search(vectors.where(F.col("id") != content_id), row["embedding"], k, threshold=None)
