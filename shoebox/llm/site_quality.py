"""Document quality from a classifier and its site: hierarchical empirical Bayes over hosts and paths.

A logistic classifier over ``FEATURES`` of the whole text, fitted on at most ``EXAMPLES`` labelled rows (those with the least
hash), gives each document a probability; its log odds less the prior's are the document's evidence. Sites are summed up by groups: each
document counts its label if it has one that may be learned from, else its probability. The spread of host rates around the global rate, and
of path rates around their host's, beyond what chance explains, gives the strength of two Beta priors by the method of moments: a
host is shrunk toward the global rate, a path toward its host, the more the fewer documents it has. A document's score joins its evidence with the
log odds of its path, from which its own part is taken out.

Sums are pre-aggregated and the join back stands hot sites; a document is one short row once its text is read.

A null text is empty. A null host or path is a site of its own. Null labels teach nothing; without labels of both kinds
the evidence is nothing and all scores are the prior. Repeated rows count each. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import text
from shoebox.llm.spark import labelled_sample, lookup
from shoebox.session import durable

EXAMPLES = 20_000
KEEP = 0.5
FEATURES = (
    "log_words", "word_length", "upper", "digits", "signs", "symbols", "distinct_words", "top_word",
    "distinct_lines", "line_length", "letters_per_byte", "short_words",
)
STRENGTH = (1.0, 1e6)

_UPPER, _DIGIT, _SIGN, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=+_/@"]] = True


class Classifier(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def features(part: text.Slice) -> np.ndarray:
    """One row of ``FEATURES`` per document of the slice."""
    docs = part.last - part.first
    raw, bounds = part.raw, part.bounds
    size = np.maximum(np.diff(bounds), 1)
    start, end, doc = text.words(raw, bounds)
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    sums = text.prefix(text.LOWER[raw])
    word = text.span_hash(sums, start, end)

    def share(kind: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(kind[raw]))
        return np.diff(upto[bounds]) / size

    def distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the largest count per document."""
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1]))) if len(o) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(o)))
        most = np.zeros(docs, np.int64)
        np.maximum.at(most, o[first], count)
        return np.bincount(o[first], minlength=docs), most

    kinds, most = distinct(doc, word)
    # Lines that hold a word, from their first word to the next newline's word.
    newline = np.append(0, np.cumsum(raw == 0x0A))
    line = newline[start]
    opens = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))) if len(start) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(start)) - 1
    lines = np.bincount(doc[opens], minlength=docs)
    line_kinds, _ = distinct(doc[opens], text.span_hash(sums, start[opens], end[closes]) if len(opens) else np.zeros(0, np.uint64))
    length = np.bincount(doc, end - start, docs)
    return np.stack(
        [
            np.log1p(n), length / some, share(_UPPER), share(_DIGIT), share(_SIGN), share(_SYMBOL), kinds / some, most / some,
            line_kinds / np.maximum(lines, 1), np.log1p(n / np.maximum(lines, 1)), length / size,
            np.bincount(doc, end - start <= 2, docs) / some,
        ],
        1,
    )


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares, and products with the length."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z * z, z[:, 1:] * z[:, :1]])


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> Classifier:
    """Classifier from at most ``limit`` documents (doc_id, text) that have a label (doc_id, quality)."""
    sample = labelled_sample(docs, labels, "quality", limit)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                rows = features(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("quality")[part.first : part.last], pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["quality", "x"]
                )

    found = sample.mapInArrow(task, "quality int, x array<double>").collect()
    y = np.array([r["quality"] for r in found], float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    n = len(FEATURES)
    if not (0 < y.sum() < len(y)):
        return Classifier(np.zeros(n), np.ones(n), np.zeros(3 * n), prior)
    x = np.array([r["x"] for r in found])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expanded(x, mean, scale)
    w = np.zeros(z.shape[1])
    w[0] = np.log(prior / (1 - prior))
    ridge = np.append(1e-6, np.full(z.shape[1] - 1, 1.0))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w, prior)


def probabilities(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows without text, with ``p``, the classifier's probability."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for part in text.slices(batch):
                z = _expanded(features(part), classifier.mean, classifier.scale) @ classifier.weights
                p[part.first : part.last] = 1 / (1 + np.exp(-np.clip(z, -12, 12))) if classifier.weights.any() else classifier.prior
            kept = [k for k, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(p)], names=[*(batch.schema.names[k] for k in kept), "p"])

    return rows.mapInArrow(task, rows.drop("text").schema.add("p", "double"))


def _strength(total: float, chance: float, rows: float, spread: float) -> float:
    """Prior strength from the observed variance of rates, that which chance explains, and the Bernoulli variance."""
    between = (total - chance) / max(rows, 1.0)
    return float(min(max(spread / between - 1, STRENGTH[0]), STRENGTH[1])) if between > 0 else STRENGTH[1]


def posteriors(counted: DataFrame) -> DataFrame:
    """Per (host, path): rows, hits, the path's prior (its host's posterior) and prior strength, from columns host, path, hit."""
    paths = durable(counted.groupBy("host", "path").agg(F.count("*").alias("rows"), F.sum("hit").alias("hits")))
    hosts = paths.groupBy("host").agg(F.sum("rows").alias("host_rows"), F.sum("hits").alias("host_hits"))
    n, s = F.col("host_rows"), F.col("host_hits")
    all_rows = hosts.agg(F.sum(n), F.sum(s), F.count("*"), F.sum(s * s / n)).first()
    rows, hits = all_rows[0] or 0, all_rows[1] or 0.0
    mean = (hits + 0.5) / (rows + 1)
    spread = mean * (1 - mean)
    total = (all_rows[3] or 0.0) - 2 * mean * hits + mean * mean * rows
    k_host = _strength(total, spread * max((all_rows[2] or 0) - 1, 0), rows, spread)
    hosts = hosts.select("host", ((s + F.lit(k_host * mean)) / (n + F.lit(k_host))).alias("host_rate"))
    # One row per host on one side, its paths on the other: neither grows with the documents.
    sites = durable(paths.withColumnRenamed("host", "site").join(hosts, F.col("site").eqNullSafe(F.col("host"))).drop("site"))
    rate = F.col("hits") / F.col("rows")
    part = sites.select(
        F.sum(F.col("rows") * (rate - F.col("host_rate")) ** 2).alias("total"),
        F.sum(F.col("host_rate") * (1 - F.col("host_rate"))).alias("chance"),
    ).first()
    k_path = _strength(part[0] or 0.0, part[1] or 0.0, rows, spread)
    return durable(sites.withColumn("strength", F.lit(k_path)))


def score(docs: DataFrame, labels: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, p, host_rate, path_rate, score and kept for rows of (doc_id, text, host, path) and the labels that count."""
    rows = durable(probabilities(docs.select(F.col("doc_id").cast("long"), "text", "host", "path"), classifier))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.join(known.agg(F.max("quality").cast("double").alias("label")), "doc_id", "left")
    rows = durable(rows).withColumn("hit", F.coalesce("label", "p")).withColumn("site", F.struct("host", "path"))
    sites = posteriors(rows).select(
        F.struct("host", "path").alias("site"), "rows", F.col("rows").alias("site_rows"), "hits", "host_rate", "strength"
    )
    joined = lookup(rows.select("doc_id", "p", "hit", "site"), sites, "site", "rows")
    others = F.col("site_rows") - 1 + F.col("strength")
    path_rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("hits") - F.col("hit") + F.col("strength") * F.col("host_rate")) / others))
    joined = joined.withColumn("path_rate", path_rate)

    def logit(c):
        return F.log(c / (1 - c))

    odds = logit(F.col("p")) - logit(F.lit(classifier.prior)) + logit(F.col("path_rate"))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "p", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("kept"))
