"""Vector columns of ``array<float>``; sums are accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    squares = F.aggregate(
        _col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalize(v) -> Column:
    """Unit vector in double; a zero vector has no direction and gives NaN, not an error."""
    v = _col(v)

    def scaled(length):
        nan = F.lit(float("nan"))
        return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(nan))

    # As a lambda variable the length is computed once per row, not once per element.
    return F.element_at(F.transform(F.array(norm(v)), scaled), 1)


def cosine(a, b) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(float("nan")))
