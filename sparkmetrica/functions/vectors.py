"""Array-column maths: dot product, norm, cosine, distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import col, ratio


def vec_sum(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double"))


def vec_dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda u, v: u.cast("double") * v.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def vec_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def vec_cosine(a: str | Column, b: str | Column) -> Column:
    return ratio(vec_dot(a, b), vec_norm(a) * vec_norm(b))


def vec_dist(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(
        col(a), col(b), lambda u, v: F.pow(u.cast("double") - v.cast("double"), F.lit(2.0))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def literal_vector(values) -> Column:
    """A short Python sequence as an ARRAY<DOUBLE> literal."""
    return F.array(*[F.lit(float(v)) for v in values])
