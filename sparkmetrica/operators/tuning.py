"""Cross-validation whose preparation is learnt inside every fold, from sums that add up over folds.

One scan gives counts, means and centred sums of every fold. The training part of a fold is the merger of all others, so
what fills missing values, centres and scales them never sees the fold it is judged on, and neither the number of folds nor that
of penalties costs another scan. Missing values are kept in the sums as a zero and a flag: a column filled with ``m`` is the
column plus ``m`` times its flag, so sums of filled columns follow for whatever ``m`` the training folds give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import num
from sparkmetrica.operators import newton
from sparkmetrica.operators import order as O
from sparkmetrica.operators.classify import fold_of
from sparkmetrica.operators.moments import Moments, moments_by
from sparkmetrica.operators.penalty import path
from sparkmetrica.session import discard, settle

FOLD = "_fold"


def finite(c) -> Column:
    """A column as DOUBLE; NaN and infinities count as missing."""
    v = num(c)
    return F.when(F.abs(v) < F.lit(float("inf")), v)


@dataclass
class Part:
    """Count, means and centred sums of ``y``, the columns with gaps as zeros, and the flags of gaps."""

    n: int
    mean: np.ndarray
    s: np.ndarray

    def __add__(self, other: Part) -> Part:
        n = self.n + other.n
        if not self.n or not other.n:
            return other if other.n else self
        apart = other.mean - self.mean
        return Part(n, self.mean + apart * other.n / n, self.s + other.s + np.outer(apart, apart) * self.n * other.n / n)

    def fill_values(self, k: int) -> np.ndarray:
        """Means of the values that are there; 0 for a column without any."""
        there = 1 - self.mean[1 + k :]
        return np.divide(self.mean[1 : 1 + k], there, out=np.zeros(k), where=there > 1e-15)

    def filled(self, fill: np.ndarray, names: list) -> Moments:
        """Moments of ``y`` and the columns after their gaps are filled."""
        k = len(fill)
        a = np.zeros((1 + k, 1 + 2 * k))
        a[0, 0] = 1.0
        a[1:, 1 : 1 + k] = np.eye(k)
        a[1:, 1 + k :] = np.diag(fill)
        return Moments(names, self.n, self.n, float(self.n), a @ self.mean, a @ self.s @ a.T)


def fold_parts(df: DataFrame, y: str, x, key, folds: int, seed: str) -> list[Part]:
    """The sums of every fold, from one scan. Rows without ``y`` have no part; a fold may be empty."""
    x = list(x)
    columns = {"y": finite(y)} | {f"x{i}": F.coalesce(finite(c), F.lit(0.0)) for i, c in enumerate(x)}
    columns |= {f"gap{i}": finite(c).isNull().cast("double") for i, c in enumerate(x)}
    size = len(columns)
    parts = [Part(0, np.zeros(size), np.zeros((size, size))) for _ in range(folds)]
    upper = np.triu_indices(size)
    for r in moments_by(df.withColumn(FOLD, fold_of(key, folds, seed)), columns, [FOLD]).collect():  # one row a fold
        if r["n"] and r[FOLD] is not None:
            s = np.zeros((size, size))
            s[upper] = np.array(r["s"], float)
            parts[r[FOLD]] = Part(r["n"], np.array(r["mean"], float), s + np.triu(s, 1).T)
    return parts


def others(parts: list[Part], fold: int) -> Part:
    """The training part of a fold. Merged, not subtracted from a total: nothing cancels."""
    out = Part(0, parts[0].mean * 0, parts[0].s * 0)
    for i, p in enumerate(parts):
        if i != fold:
            out = out + p
    return out


def squared_error(m: Moments, y: str, x: list, intercept: float, slopes: np.ndarray) -> float:
    """Sum of squared errors of a linear prediction, from moments alone."""
    v = np.concatenate([[1.0], -slopes])
    s = m.block([y, *x], [y, *x])
    gap = m.means([y])[0] - intercept - m.means(x) @ slopes
    return float(max(v @ s @ v, 0.0) + m.n * gap * gap)


SCORES = "strength double, fold int, n_train bigint, n_test bigint, mse double"


def tune_net(df: DataFrame, y: str, x, key, strengths, mix: float = 0.0, folds: int = 5, seed: str = "folds") -> DataFrame:
    """Held-out mean squared error of a ridge, lasso or net for every strength and fold: one scan for all of them.

    ``key`` (a column or several) decides the fold by a hash, so rows that share it stay together. Gaps are filled with means of
    the training folds, in them and in the fold that is judged. A fold without rows, or that holds all, has no score.
    """
    x = list(x)
    names = [f"x{i}" for i in range(len(x))]
    parts = fold_parts(df, y, x, key, folds, seed)
    rows = []
    for fold, held in enumerate(parts):
        train = others(parts, fold)
        if not train.n or not held.n:
            continue
        fill = train.fill_values(len(x))
        fitted, judged = train.filled(fill, ["y", *names]), held.filled(fill, ["y", *names])
        for fit in path(fitted, "y", names, [float(s) for s in strengths], mix):
            rows.append((fit.strength, fold, train.n, held.n, squared_error(judged, "y", names, fit.intercept, fit.slopes) / held.n))
    return df.sparkSession.createDataFrame(rows, SCORES)


def chosen(scores: DataFrame, value: str = "mse") -> DataFrame:
    """Mean and standard error over folds of every strength; ``best`` has the least mean, ``simplest`` is the strongest within one error of it."""
    table = scores.groupBy("strength").agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    rows = sorted(tuple(r) for r in table.collect())  # one row a strength
    best = min(rows, key=lambda r: (r[2], -r[0]))
    simplest = max(r[0] for r in rows if r[2] <= best[2] + (best[3] or 0.0))
    out = [(*r, r[0] == best[0], r[0] == simplest) for r in rows]
    return scores.sparkSession.createDataFrame(out, "strength double, folds bigint, mean double, se double, best boolean, simplest boolean")


def levels_of(df: DataFrame, column: str, most: int = 200) -> list:
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels: lump the rare ones first")
    return sorted(found)


def indicators(df: DataFrame, categorical, most: int = 200) -> tuple[DataFrame, list]:
    """0/1 columns for all levels. One that the training folds lack has no variation there, so its coefficient is zero: nothing is learnt from it."""
    made = {f"{c}={level}": F.coalesce((F.col(c) == F.lit(level)).cast("double"), F.lit(0.0)) for c in categorical for level in levels_of(df, c, most)}
    names = [f"_level{i}" for i in range(len(made))]
    return df.withColumns(dict(zip(names, made.values(), strict=True))), names


def tune_logit(df: DataFrame, label: str, numeric, key, penalties, categorical=(), folds: int = 3, seed: str = "folds", weight: str | None = None) -> tuple[DataFrame, list]:
    """``(strength, fold, n_train, n_test, log_loss, auc, slope, converged)`` of a logistic regression, and its models.

    Filling, centring and scaling come from the training folds (one scan), all models of all folds are fitted together by
    Newton's method. ``slope`` is what is left of the gradient.
    """
    spark = df.sparkSession
    wide, added = indicators(df, categorical)
    columns = [*numeric, *added]
    parts = fold_parts(wide, label, columns, key, folds, seed)
    rows = settle(newton.batches_of(wide.withColumn(FOLD, fold_of(key, folds, seed)), columns, label, FOLD, weight))
    models = []
    for fold, held in enumerate(parts):
        train = others(parts, fold)
        if train.n and held.n:
            fill = train.fill_values(len(columns))
            m = train.filled(fill, ["y", *columns])
            spread = np.sqrt(np.maximum(np.diag(m.s)[1:], 0.0) / m.n)
            spread[spread <= 1e-14 * np.maximum(1.0, np.abs(m.mean[1:]))] = 0.0
            models += [newton.Logit(fill, m.mean[1:], spread, float(p), fold) for p in penalties]
    newton.fit(rows, models)
    held = settle(newton.scored(rows, models, held_out=True))
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = held.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("loss")).collect()  # one row a model
    counts = O.ordered_counts(held, "score", ["model"], {"pos": (F.col("y") == 1).cast("bigint")})
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    area = F.try_divide(F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2, (pos * neg).cast("double"))
    areas = {r["model"]: r["auc"] for r in counts.groupBy("model").agg(area.alias("auc")).collect()}
    discard(rows, held)
    out = [
        (models[r["model"]].penalty, models[r["model"]].without, models[r["model"]].rows, r["n"], r["loss"], areas.get(r["model"]), models[r["model"]].slope, models[r["model"]].converged)
        for r in loss
    ]
    schema = "strength double, fold int, n_train bigint, n_test bigint, log_loss double, auc double, slope double, converged boolean"
    return spark.createDataFrame(sorted(out), schema), models
