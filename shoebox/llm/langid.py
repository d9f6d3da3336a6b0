"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram of letters and word gaps
is bound into one vector: the product of its letters' vectors, each rolled by its place. A text's vector is the bundle
(sum) of its n-grams' vectors; a language's prototype is the bundle over all its training texts. A text gets the
language of the prototype with the largest cosine, ties the first by name; the score is that cosine, not below 0.

``fit`` sums vectors per language inside tasks, then in Spark; whole counts make the sums exact in any order. Only
one vector per language reaches the driver. ``predict`` is one pass without a shuffle.

A null text, or one without a letter, is ``und`` with score 0, and teaches nothing; so are all texts if nothing was
learned. Rows with a null language teach nothing. Repeated rows count each. Extra columns are kept by ``predict``'s caller.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm import text

DIMENSIONS = 1024
GRAM = 3
BLOCK = 2048
OWNERS = 512  # documents whose vectors are held at once
UNKNOWN = "und"
SPACE = 32


class Profiles(NamedTuple):
    names: list[str]
    vectors: np.ndarray  # unit length, one row per language


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a space for anything else."""
    fold = np.full(0x110000, SPACE, np.int32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            fold[point] = ord(low) if len(low) == 1 else point
    return fold


@text.held
@functools.lru_cache(maxsize=4096)
def _vector(point: int, size: int) -> np.ndarray:
    return (np.random.default_rng([text.SEED, point]).integers(0, 2, size) * 2 - 1).astype(np.float32)


def _symbols(part: text.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, runs of anything else as one gap, a gap around each text; and each symbol's document."""
    points = np.frombuffer(part.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (part.raw & 0xC0) != 0x80
    bounds = np.append(0, np.cumsum(lead))[part.bounds] if len(lead) else np.zeros(len(part.bounds), np.int64)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size + 1)
    fold = _letters()[np.insert(points, bounds[:-1], SPACE)] if len(points) else np.full(len(doc), SPACE, np.int32)
    fold, doc = np.append(fold, SPACE), np.append(doc, len(size))
    keep = np.ones(len(fold), bool)
    keep[1:] = (fold[1:] != SPACE) | (fold[:-1] != SPACE) | (doc[1:] != doc[:-1])
    return fold[keep], doc[keep]


def _grams(part: text.Slice, gram: int):
    """(document, n-gram number, count) of a slice, and each n-gram's code points."""
    symbol, doc = _symbols(part)
    alphabet, index = np.unique(symbol, return_inverse=True)
    many = len(alphabet)
    n = len(symbol) - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, gram), np.int64)
    code = np.zeros(n, np.int64)
    for k in range(gram):
        code = code * many + index[k : k + n]
    # A text's own closing gap is the opening gap of the next; no n-gram holds letters of two texts.
    owner = doc[:n]
    inside = (doc[gram - 1 :] == owner) | ((symbol[gram - 1 :] == SPACE) & (doc[gram - 2 : gram - 2 + n] == owner))
    inside &= symbol[1 : 1 + n] != SPACE if gram > 2 else True
    used, number = np.unique(code[inside], return_inverse=True)
    pair, count = np.unique(owner[inside] * len(used) + number, return_counts=True)
    points = np.stack([alphabet[used // many ** (gram - 1 - k) % many] for k in range(gram)], 1)
    return pair // max(len(used), 1), pair % max(len(used), 1), count, points


def _bound(points: np.ndarray, size: int) -> np.ndarray:
    """The vector of each n-gram."""
    gram = points.shape[1]
    out = np.ones((len(points), size), np.float32)
    for k in range(gram):
        letters, index = np.unique(points[:, k], return_inverse=True)
        rolled = [np.roll(_vector(int(p), size), gram - 1 - k) for p in letters]
        if rolled:
            out *= np.stack(rolled)[index]
    return out


def _bundles(part: text.Slice, owner: np.ndarray, owners: int, size: int, gram: int) -> np.ndarray:
    """Sum of n-gram vectors per owner; ``owner`` maps each document, below 0 for none."""
    doc, number, count, points = _grams(part, gram)
    who = owner[doc]
    mine = who >= 0
    order = np.argsort(number[mine], kind="stable")
    who, number, count = who[mine][order], number[mine][order], count[mine][order].astype(np.float32)
    out = np.zeros((owners, size), np.float32)
    for low in range(0, len(points), BLOCK):  # whole numbers: blocks add up exactly
        a, b = np.searchsorted(number, [low, low + BLOCK])
        dense = np.zeros((owners, min(BLOCK, len(points) - low)), np.float32)
        np.add.at(dense, (who[a:b], number[a:b] - low), count[a:b])
        out += dense @ _bound(points[low : low + BLOCK], size)
    return out


def _few(part: text.Slice) -> Iterator[text.Slice]:
    """A slice of many short documents in slices of at most ``OWNERS``: each document has a vector of its own."""
    for low in range(0, part.last - part.first, OWNERS):
        high = min(low + OWNERS, part.last - part.first)
        a, b = part.bounds[low], part.bounds[high]
        yield text.Slice(part.first + low, part.first + high, part.raw[a:b], part.bounds[low : high + 1] - a, part.null[low:high])


def fit(examples: DataFrame, size: int = DIMENSIONS, gram: int = GRAM) -> Profiles:
    """Prototypes from columns text and lang."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in text.slices(batch):
                here = langs[part.first : part.last]
                names = sorted(set(here))
                owner = np.array([names.index(x) for x in here])
                for name, row in zip(names, _bundles(part, owner, len(names), size, gram), strict=True):
                    sums[name] = sums.get(name, 0) + row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    rows = examples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = rows.mapInArrow(text.returned(task), "lang string, vector array<double>").select("lang", F.posexplode("vector"))
    total = parts.groupBy("lang", "pos").agg(F.sum("col").alias("value")).groupBy("lang")
    found = total.agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("vector")).orderBy("lang").collect()
    profiles = {r["lang"]: np.array([x["value"] for x in r["vector"]]) for r in found}
    profiles = {name: v / np.linalg.norm(v) for name, v in profiles.items() if v.any()}
    return Profiles(list(profiles), np.array(list(profiles.values()), np.float32))


def predict(rows: DataFrame, profiles: Profiles, gram: int = GRAM) -> DataFrame:
    """The rows with lang_pred and score added; columns of these names are replaced."""
    rows = rows.drop("lang_pred", "score")
    names, vectors = profiles

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for part in (few for some in text.slices(batch) for few in _few(some)):
                docs = part.last - part.first
                bundle = _bundles(part, np.arange(docs + 1), docs + 1, vectors.shape[1] if names else 1, gram)[:docs]
                length = np.linalg.norm(bundle, axis=1)
                known = np.flatnonzero((length > 0) & bool(names))
                if len(known):
                    cosine = bundle[known] @ vectors.T / length[known][:, None]
                    label[part.first + known] = np.array(names, object)[cosine.argmax(1)]
                    score[part.first + known] = np.clip(cosine.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(text.returned(task), schema)
