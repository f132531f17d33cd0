"""Centred cross-product sums: the one pass over the data behind linear models.

``covar_pop`` merges centred partial sums, so a single scan is numerically safe.
Wide designs and weighted ones take the means first and then sum the products.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import num
from sparkmetrica.operators.arrays import gram

# Above this many columns one d-by-d matrix per partition beats d^2/2 aggregates.
WIDE = 24


@dataclass
class Moments:
    """``n`` complete rows of ``n_total``; mean vector and centred sums ``s``."""

    names: list
    n: int
    n_total: int
    weight: float
    mean: np.ndarray
    s: np.ndarray
    log_weight: float = 0.0  # sum of the logarithms of the weights

    def at(self, names) -> list[int]:
        return [self.names.index(n) for n in names]

    def block(self, rows, columns) -> np.ndarray:
        return self.s[np.ix_(self.at(rows), self.at(columns))]

    def means(self, names) -> np.ndarray:
        return self.mean[self.at(names)]


def _columns(columns) -> dict[str, Column]:
    """Names or ready DOUBLE columns; NaN in named ones counts as missing."""
    return dict(columns) if isinstance(columns, dict) else {c: num(c) for c in columns}


def complete_rows(df: DataFrame, columns: dict, keep=(), weight=None) -> DataFrame:
    """The columns as DOUBLE, all NULL where any of them is missing or infinite.

    Rows are masked, not filtered: aggregates skip NULL anyway, and a filter on a
    derived column would be pushed down and make Spark compute the column twice.
    """
    got = dict(columns)
    if weight is not None:
        got["_w"] = num(weight)
    rows = df.select(*keep, *[c.alias(f"_v{i}") for i, c in enumerate(got.values())])
    names = [f"_v{i}" for i in range(len(got))]
    # NULL and NaN fail the comparison too: no path below meets a value that it would treat in its own way
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(n)) < F.lit(float("inf")), F.lit(False)) for n in names])
    if weight is not None:
        ok = ok & (F.col(names[-1]) > 0)
    out = {n: F.when(ok, F.col(v)) for n, v in zip(got, names)}
    return rows.select(*keep, *[c.alias(n) for n, c in out.items()])


def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(k: int, values) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), values):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return out


def pair_sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """``sum(c_i c_j)`` for every pair of column expressions, in one aggregation."""
    k = len(columns)
    rows = df.select(*[c.alias(f"_p{i}") for i, c in enumerate(columns)])
    if k > WIDE:
        # a score row is NULL in all its columns or in none
        vectors = rows.select(F.when(F.col("_p0").isNotNull(), F.array(*rows.columns)).alias("x"))
        out = np.zeros((k, k))
        for r in gram(vectors, "x").collect():  # k^2 numbers
            out[r["i"], r["j"]] = r["v"]
        return out
    sums = [F.sum(F.col(f"_p{i}") * F.col(f"_p{j}")).alias(f"_{i}_{j}") for i, j in _pairs(k)]
    return _symmetric(k, rows.agg(*sums).first())


def moments(df: DataFrame, columns, weight=None) -> Moments:
    """Moments of the rows without a missing value; NULL counts are reported."""
    columns = _columns(columns)
    names, k = list(columns), len(columns)
    rows = complete_rows(df, columns, weight=weight)
    counts = [F.count(F.lit(1)), F.count(F.col(names[0]))]
    if weight is None and k <= WIDE:
        aggs = [F.avg(n) for n in names] + [F.covar_pop(names[i], names[j]) for i, j in _pairs(k)]
        got = list(rows.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts + aggs)]).first())
        total, n = got[:2]
        if not n:
            raise ValueError("no complete rows")
        return Moments(names, n, total, float(n), np.array(got[2 : 2 + k], float), n * _symmetric(k, got[2 + k :]))
    w = F.col("_w") if weight is not None else F.when(F.col(names[0]).isNotNull(), F.lit(1.0))
    aggs = [F.sum(w), F.sum(F.ln(w))] + [F.sum(w * F.col(n)) for n in names]
    got = list(rows.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts + aggs)]).first())
    total, n, weights, logs = got[:4]
    if not n:
        raise ValueError("no complete rows")
    mean = np.array(got[4:], float) / weights
    centred = [F.sqrt(w) * (F.col(c) - F.lit(float(m))) for c, m in zip(names, mean)]
    return Moments(names, n, total, float(weights), mean, pair_sums(rows, centred), float(logs))


def moments_by(df: DataFrame, columns, by) -> DataFrame:
    """Moments per group as ``(by..., n, mean ARRAY, s ARRAY)``, upper triangle by rows."""
    columns = _columns(columns)
    names = list(columns)
    # names of the data columns may equal the grouping columns, so use positions
    columns = {f"_x{i}": c for i, c in enumerate(columns.values())}
    rows = complete_rows(df, columns, keep=list(by))
    slots = list(columns)
    pairs = _pairs(len(names))
    grouped = rows.groupBy(*by).agg(
        F.count(slots[0]).alias("n"),
        *[F.avg(s).alias(f"_m{s}") for s in slots],
        *[F.covar_pop(slots[i], slots[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    )
    return grouped.select(
        *by,
        "n",
        F.array(*[F.col(f"_m{s}") for s in slots]).alias("mean"),
        F.array(*[F.col("n") * F.col(f"_c{i}_{j}") for i, j in pairs]).alias("s"),
    )


def within_moments(df: DataFrame, columns, by) -> tuple[Moments, int]:
    """Cross-product sums around the group means, and the number of groups.

    The within-group sums of each group add up, so no row is demeaned or joined.
    """
    names = list(_columns(columns))
    groups = moments_by(df, columns, by).where("n > 0")
    total = df.count()
    k = len(names)
    size = len(_pairs(k))
    got = list(
        groups.agg(
            F.sum("n"),
            F.count(F.lit(1)),
            *[F.sum(F.col("n") * F.col("mean")[i]) / F.sum("n") for i in range(k)],
            *[F.sum(F.col("s")[i]) for i in range(size)],
        ).first()
    )
    n, g = got[:2]
    return Moments(names, n, total, float(n), np.array(got[2 : 2 + k], float), _symmetric(k, got[2 + k :])), g
