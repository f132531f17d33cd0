"""Linear regression with robust inference and specification tests.

The data is reduced to a k-by-k matrix by :mod:`moments`; numpy solves that on
the driver. Row-level results put the coefficients back as literals.

Regressors are kept centred inside a fit: there the intercept is orthogonal to
the slopes, which keeps the inverse well conditioned for prices and years.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmetrica.functions import dist
from sparkmetrica.functions.scalars import num, ratio
from sparkmetrica.operators.hypothesis import jarque_bera
from sparkmetrica.operators.moments import (
    Moments, complete_rows, moments, moments_by, pair_sums, within_moments,
)
from sparkmetrica.operators.penalty import net_path

TOLERANCE = 1e-10
CONST = "const"


@dataclass
class Fit:
    """A fitted linear model. ``beta`` and ``cov`` start with the intercept."""

    y: str
    x: list
    columns: dict  # name -> Column of every variable, y included
    m: Moments
    slopes: np.ndarray
    inverse: np.ndarray  # of the centred cross products of the (projected) regressors
    rss: float
    df_resid: int
    dropped: list = field(default_factory=list)
    weight: str | None = None
    cov_kind: str = "classical"
    cov: np.ndarray | None = None
    projection: np.ndarray | None = None  # 2SLS: coefficients of x on z
    z: list = field(default_factory=list)
    absorbed: int = 0  # groups whose intercepts were absorbed

    def __post_init__(self):
        if self.cov is None:
            s2 = self.rss / self.df_resid
            k = len(self.x)
            centred = np.zeros((k + 1, k + 1))
            centred[0, 0] = s2 / self.m.weight
            centred[1:, 1:] = s2 * self.inverse
            self.cov = self.uncentre(centred)

    def uncentre(self, cov: np.ndarray) -> np.ndarray:
        """Covariance of (centred intercept, slopes) to that of (intercept, slopes)."""
        t = np.eye(len(self.x) + 1)
        t[0, 1:] = -self.m.means(self.x)
        return t @ cov @ t.T

    @property
    def names(self) -> list:
        return [CONST, *self.x]

    @property
    def beta(self) -> np.ndarray:
        a = self.m.means([self.y])[0] - self.m.means(self.x) @ self.slopes
        return np.concatenate([[a], self.slopes])

    @property
    def n(self) -> int:
        return self.m.n

    @property
    def tss(self) -> float:
        return float(self.m.block([self.y], [self.y])[0, 0])

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        t = self.beta / self.se
        half = dist.t_critical(level, float(self.df_resid)) * self.se
        frame = zip(self.names, self.beta, self.se, t, dist.t_two_sided(t, self.df_resid), self.beta - half, self.beta + half)
        rows = [(r[0], *[float(v) for v in r[1:]]) for r in frame]
        return spark.createDataFrame(
            rows, "term string, coef double, se double, t double, p double, ci_lo double, ci_hi double"
        )

    def measures(self) -> dict:
        n, k = self.n, len(self.x)
        f = ((self.tss - self.rss) / k) / (self.rss / self.df_resid) if k and self.projection is None else None
        loglik = -0.5 * n * (math.log(2 * math.pi * self.rss / n) + 1) + 0.5 * self.m.log_weight
        used = k + max(1, self.absorbed)  # slopes and intercepts
        return {
            "n": n, "n_dropped": self.m.n_total - n, "k": k, "df_resid": self.df_resid,
            "r2": self.r2, "adj_r2": 1 - (1 - self.r2) * (n - 1) / self.df_resid,
            "sigma": math.sqrt(self.rss / self.df_resid), "f": f,
            "f_p": None if f is None else float(dist.f_tail(f, k, self.df_resid)),
            "aic": -2 * loglik + 2 * used, "bic": -2 * loglik + math.log(n) * used,
        }

    def summary(self, spark: SparkSession) -> DataFrame:
        got = self.measures()
        kinds = ", ".join(f"{c} {'bigint' if isinstance(v, int) else 'double'}" for c, v in got.items())
        return spark.createDataFrame([tuple(got.values())], kinds)

    # expressions over the rows the model was fitted on, or new ones

    def fitted(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for b, c in zip(self.slopes, self.x):
            out = out + F.lit(float(b)) * self.columns[c]
        return out

    def residual(self) -> Column:
        return self.columns[self.y] - self.fitted()

    def centred(self) -> list[Column]:
        """1 and the centred regressors; for 2SLS their projections on the instruments."""
        used = self.z if self.projection is not None else self.x
        deviations = [self.columns[c] - F.lit(float(m)) for c, m in zip(used, self.m.means(used))]
        if self.projection is not None:
            deviations = [
                sum((F.lit(float(w)) * d for w, d in zip(col[1:], deviations[1:])), F.lit(float(col[0])) * deviations[0])
                for col in self.projection.T
            ]
        return [F.lit(1.0), *deviations]

    def leverage(self) -> Column:
        c = self.centred()[1:]
        out = F.lit(1.0 / self.m.weight)
        for i, a in enumerate(c):
            for j, b in enumerate(c[i:], i):
                out = out + F.lit(float(self.inverse[i, j] * (1 if i == j else 2))) * a * b
        return out * num(self.weight) if self.weight else out

    def used(self) -> dict:
        return {n: self.columns[n] for n in [self.y, *self.x, *[z for z in self.z if z not in self.x]]}

    def rows(self, df: DataFrame, keep=(), **columns: Column) -> DataFrame:
        """Expressions over the rows of ``df``, NULL where a variable is missing.

        Nothing is filtered: see :func:`moments.complete_rows`.
        """
        ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in self.used().values()])
        if self.weight:
            ok = ok & (num(self.weight) > 0)
        return df.select(*keep, *[F.when(ok, c).alias(n) for n, c in columns.items()])


def independent(s: np.ndarray) -> list[int]:
    """Columns kept, in order, when constant and collinear ones are left out."""
    kept: list[int] = []
    for j in range(len(s)):
        left = s[j, j]
        if kept and left > 0:
            cross = s[np.ix_(kept, [j])][:, 0]
            scale = np.sqrt(np.diag(s)[kept])
            corr = s[np.ix_(kept, kept)] / np.outer(scale, scale)
            left = left - (cross / scale) @ np.linalg.solve(corr, cross / scale)
        if left > TOLERANCE * max(s[j, j], 1e-300):
            kept.append(j)
    return kept


def inverse_of(s: np.ndarray) -> np.ndarray:
    """Inverse by way of the correlation form."""
    scale = np.sqrt(np.diag(s))
    return np.linalg.inv(s / np.outer(scale, scale)) / np.outer(scale, scale)


def _keep(m: Moments, x) -> tuple[list, list]:
    x = list(x)
    kept = [x[i] for i in independent(m.block(x, x))]
    dropped = [c for c in x if c not in kept]
    if dropped:
        warnings.warn(f"constant or collinear columns left out: {', '.join(dropped)}", stacklevel=3)
    return kept, dropped


def fit_moments(m: Moments, y: str, x, columns: dict, weight=None, df_used: int = 1) -> Fit:
    """OLS from a moment matrix; ``df_used`` counts the intercepts."""
    kept, dropped = _keep(m, x)
    inverse = inverse_of(m.block(kept, kept)) if kept else np.zeros((0, 0))
    sxy = m.block(kept, [y])[:, 0]
    slopes = inverse @ sxy
    rss = max(float(m.block([y], [y])[0, 0] - slopes @ sxy), 0.0)
    freedom = m.n - len(kept) - df_used
    if freedom <= 0:
        raise ValueError("not enough rows for this many regressors")
    return Fit(y, kept, columns, m, slopes, inverse, rss, freedom, dropped, weight)


def variables(names, extra: dict | None = None) -> dict:
    return {n: num(n) for n in names} | {n: num(c) for n, c in (extra or {}).items()}


def ols(df: DataFrame, y: str, x) -> Fit:
    columns = variables([y, *x])
    return fit_moments(moments(df, columns), y, x, columns)


def wls(df: DataFrame, y: str, x, weight: str) -> Fit:
    columns = variables([y, *x])
    return fit_moments(moments(df, columns, weight), y, x, columns, weight)


def _sandwich(fit: Fit, meat: np.ndarray, factor: float, kind: str) -> Fit:
    k = len(fit.x)
    bread = np.zeros((k + 1, k + 1))
    bread[0, 0] = 1.0 / fit.m.weight
    bread[1:, 1:] = fit.inverse
    cov = fit.uncentre(factor * bread @ meat @ bread)
    got = Fit(**{**fit.__dict__, "cov": cov, "cov_kind": kind})
    return got


def _score_rows(fit: Fit, df: DataFrame, keep=(), factor: Column | None = None) -> tuple[DataFrame, list]:
    error = fit.residual() * (num(fit.weight) if fit.weight else F.lit(1.0))
    if factor is not None:
        error = error * factor
    scores = {f"_s{i}": error * c for i, c in enumerate(fit.centred())}
    return fit.rows(df, keep, **scores), list(scores)


def robust_cov(fit: Fit, df: DataFrame, kind: str = "HC1") -> Fit:
    """The fit with White standard errors ``HC0``..``HC3`` (also after 2SLS: HC0, HC1)."""
    factor = {"HC2": F.sqrt(ratio(F.lit(1.0), 1 - fit.leverage())), "HC3": ratio(F.lit(1.0), 1 - fit.leverage())}.get(kind)
    rows, scores = _score_rows(fit, df, factor=factor)
    meat = pair_sums(rows, [F.col(s) for s in scores])
    return _sandwich(fit, meat, fit.n / fit.df_resid if kind == "HC1" else 1.0, kind)


def cluster_cov(fit: Fit, df: DataFrame, by: str, kind: str = "CR1") -> Fit:
    """Cluster-robust standard errors: ``CR0``, or ``CR1`` with the small-sample factor.

    A cluster of any size is summed on the map side; only k+1 sums per cluster move.
    Rows without a cluster are a cluster of their own, so every row of the fit counts. After
    :func:`within` the rows would have to be demeaned, so that fit is rejected.
    """
    if fit.absorbed:
        raise ValueError("cluster_cov needs the residuals of a fit without absorbed groups")
    rows, scores = _score_rows(fit, df, keep=[by])
    sums = rows.groupBy(by).agg(
        *[F.sum(s).alias(s) for s in scores], F.count(scores[0]).alias("_n")
    )
    sums = sums.where("_n > 0")
    meat = pair_sums(sums, [F.col(s) for s in scores] + [F.lit(1.0)])
    g = meat[-1, -1]
    factor = 1.0 if kind == "CR0" else g / (g - 1) * (fit.n - 1) / fit.df_resid
    return _sandwich(fit, meat[:-1, :-1], factor, kind)


def wald(fit: Fit, r, q=None) -> dict:
    """F test of ``R beta = q``; rows of ``r`` run over ``fit.names``."""
    r = np.atleast_2d(np.asarray(r, float))
    q = np.zeros(len(r)) if q is None else np.asarray(q, float)
    gap = r @ fit.beta - q
    f = float(gap @ np.linalg.solve(r @ fit.cov @ r.T, gap) / len(r))
    return {"f": f, "df1": len(r), "df2": fit.df_resid, "p": float(dist.f_tail(f, len(r), fit.df_resid))}


def as_table(spark: SparkSession, result: dict) -> DataFrame:
    kinds = {int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame(
        [tuple(result.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in result.items())
    )


def chow(df: DataFrame, y: str, x, by: str) -> dict:
    """Equality of all coefficients across the groups of ``by``."""
    rows = df.where(F.col(by).isNotNull())
    pooled = ols(rows, y, x)
    parts = ols_by(rows, [by], y, x).where(F.col("term") == CONST)
    got = parts.agg(F.sum("rss"), F.count(F.lit(1)), F.sum("n")).first()
    rss, g = float(got[0]), got[1]
    k = len(pooled.x) + 1
    d1, d2 = (g - 1) * k, pooled.n - g * k
    if got[2] != pooled.n:
        raise ValueError("a group is too small, or has a constant regressor: no separate fit")
    f = ((pooled.rss - rss) / d1) / (rss / d2)
    return {"f": f, "df1": d1, "df2": d2, "p": float(dist.f_tail(f, d1, d2)), "groups": g}


def vif(fit: Fit, spark: SparkSession) -> DataFrame:
    """Variance inflation per regressor, and the condition number of the scaled design."""
    s = fit.m.block(fit.x, fit.x)
    inflation = np.diag(s) * np.diag(fit.inverse)
    mean = fit.m.means(fit.x)
    full = np.zeros((len(s) + 1, len(s) + 1))
    full[0, 0] = fit.m.weight
    full[0, 1:] = full[1:, 0] = fit.m.weight * mean
    full[1:, 1:] = s + fit.m.weight * np.outer(mean, mean)
    scale = np.sqrt(np.diag(full))
    roots = np.linalg.eigvalsh(full / np.outer(scale, scale))
    condition = math.sqrt(roots[-1] / max(roots[0], 1e-300))
    rows = [(c, float(v), condition) for c, v in zip(fit.x, inflation)]
    return spark.createDataFrame(rows, "term string, vif double, condition_number double")


def _auxiliary(fit: Fit, df: DataFrame, target: Column, regressors: dict) -> dict:
    rows = fit.rows(df, _t=target, **regressors)
    aux = ols(rows, "_t", list(regressors))
    lm, k = aux.n * aux.r2, len(aux.x)
    f = (aux.r2 / k) / ((1 - aux.r2) / aux.df_resid)
    return {
        "lm": lm, "df": k, "p": float(dist.chi2_tail(lm, k)),
        "f": f, "f_p": float(dist.f_tail(f, k, aux.df_resid)),
    }


def bp_test(fit: Fit, df: DataFrame) -> dict:
    """Breusch-Pagan (studentised): squared residuals on the regressors."""
    e = fit.residual()
    return _auxiliary(fit, df, e * e, {f"_x{i}": fit.columns[c] for i, c in enumerate(fit.x)})


def white_test(fit: Fit, df: DataFrame) -> dict:
    """White: squared residuals on regressors, their squares and cross products."""
    e = fit.residual()
    c = fit.centred()[1:]
    regressors = {f"_x{i}": v for i, v in enumerate(c)}
    regressors |= {f"_x{i}_{j}": c[i] * c[j] for i in range(len(c)) for j in range(i, len(c))}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the square of a dummy is the dummy
        return _auxiliary(fit, df, e * e, regressors)


def reset_test(fit: Fit, df: DataFrame, powers=(2, 3)) -> dict:
    """Ramsey RESET: powers of the fitted values added to the design."""
    spread = math.sqrt(max(fit.tss - fit.rss, 1e-300) / fit.n)
    scaled = (fit.fitted() - F.lit(float(fit.m.means([fit.y])[0]))) / F.lit(spread)
    added = {f"_p{p}": F.pow(scaled, F.lit(float(p))) for p in powers}
    base = {f"_x{i}": fit.columns[c] for i, c in enumerate(fit.x)}
    wide = ols(fit.rows(df, _t=fit.columns[fit.y], **base, **added), "_t", [*base, *added])
    d1 = len(wide.x) - len(fit.x)
    f = ((fit.rss - wide.rss) / d1) / (wide.rss / wide.df_resid)
    return {"f": f, "df1": d1, "df2": wide.df_resid, "p": float(dist.f_tail(f, d1, wide.df_resid))}


def residual_normality(fit: Fit, df: DataFrame) -> DataFrame:
    return jarque_bera(fit.rows(df, e=fit.residual()), "e")


def influence(fit: Fit, df: DataFrame) -> DataFrame:
    """Rows with fitted value, leverage, studentised residuals and Cook's distance
    (NULL where a variable is missing)."""
    s2, k = fit.rss / fit.df_resid, len(fit.x) + 1
    scaled = fit.residual() * F.sqrt(num(fit.weight)) if fit.weight else fit.residual()
    rows = fit.rows(df, df.columns, fitted=fit.fitted(), residual=fit.residual(), leverage=fit.leverage(), _e=scaled)
    e, h = F.col("_e"), F.col("leverage")
    inner = ratio(e, F.sqrt(F.lit(s2) * (1 - h)))
    left_out = ratio(F.lit(fit.rss) - ratio(e * e, 1 - h), F.lit(float(fit.df_resid - 1)))
    return rows.withColumns(
        {
            "student": inner,
            "student_ext": ratio(e, F.sqrt(left_out * (1 - h))),
            "cooks_d": inner * inner / k * ratio(h, 1 - h),
        }
    ).drop("_e")


def compare(df: DataFrame, y: str, candidates: dict) -> DataFrame:
    """Candidate sets of regressors on the same rows: one scan, one row per model."""
    union = list(dict.fromkeys(c for x in candidates.values() for c in x))
    columns = variables([y, *union])
    m = moments(df, columns)
    rows = []
    for name, x in candidates.items():
        got = fit_moments(m, y, x, columns).measures()
        rows.append((name, *[got[c] for c in ("k", "n", "r2", "adj_r2", "sigma", "aic", "bic")]))
    return df.sparkSession.createDataFrame(
        rows, "model string, k bigint, n bigint, r2 double, adj_r2 double, sigma double, aic double, bic double"
    )


def stepwise(df: DataFrame, y: str, x, criterion: str = "aic", direction: str = "forward") -> tuple[Fit, list]:
    """Forward or backward selection; all steps use one moment matrix."""
    columns = variables([y, *x])
    m = moments(df, columns)
    pool, _ = _keep(m, x)

    def score(names):
        return fit_moments(m, y, names, columns).measures()[criterion]

    chosen = [] if direction == "forward" else list(pool)
    best, path = score(chosen), []
    while True:
        if direction == "forward":
            moves = [(c, chosen + [c]) for c in pool if c not in chosen]
        else:
            moves = [(c, [v for v in chosen if v != c]) for c in chosen]
        scored = sorted((score(names), c, names) for c, names in moves)
        if not scored or scored[0][0] >= best:
            break
        best, moved, chosen = scored[0]
        path.append((moved, best))
    return fit_moments(m, y, chosen, columns), path


def ols_by(df: DataFrame, by, y: str, x) -> DataFrame:
    """A separate regression per group: ``by..., term, coef, se, t, n, r2, rss, reason``.

    A group without enough rows, or with a constant or collinear column, has NULL
    estimates and says why in ``reason``; a group without a complete row has ``n`` 0. Each group is already one
    row of sums when it is solved.
    """
    by, x = list(by), list(x)
    k = len(x)
    stats = moments_by(df, variables([y, *x]), by)
    upper = np.triu_indices(k + 1)

    def solve(batches):
        for pdf in batches:
            out = []
            for key, n, mean, flat in zip(pdf[by].itertuples(index=False), pdf["n"], pdf["mean"], pdf["s"]):
                s = np.zeros((k + 1, k + 1))
                s[upper] = flat if n else 0.0
                s = s + np.triu(s, 1).T
                freedom = n - k - 1
                reason = "too few rows" if freedom <= 0 else "constant or collinear" if len(independent(s[1:, 1:])) < k else None
                if reason:
                    out += [(*key, name, None, None, None, n, None, None, reason) for name in [CONST, *x]]
                    continue
                inverse = inverse_of(s[1:, 1:]) if k else np.zeros((0, 0))
                slopes = inverse @ s[1:, 0]
                rss = max(s[0, 0] - slopes @ s[1:, 0], 0.0)
                s2, means = rss / freedom, np.asarray(mean)
                beta = np.concatenate([[means[0] - means[1:] @ slopes], slopes])
                variance = np.concatenate([[1 / n + means[1:] @ inverse @ means[1:]], np.diag(inverse)])
                se = np.sqrt(s2 * variance)
                r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else np.nan
                for name, b, e in zip([CONST, *x], beta, se):
                    out.append((*key, name, b, e, b / e if e > 0 else np.nan, n, r2, rss, None))
            names = [*by, "term", "coef", "se", "t", "n", "r2", "rss", "reason"]
            yield pd.DataFrame(out, columns=names)

    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return stats.mapInPandas(
        solve, f"{keys}, term string, coef double, se double, t double, n bigint, r2 double, rss double, reason string"
    )


def within(df: DataFrame, by, y: str, x) -> Fit:
    """Fixed effects of ``by``: slopes from within-group variation.

    The group means absorb the intercepts, so ``df_resid`` loses one per group, and the
    information criteria count them as parameters.
    """
    columns = variables([y, *x])
    by = [by] if isinstance(by, str) else list(by)
    m, groups = within_moments(df, columns, by)
    fit = fit_moments(m, y, x, columns, df_used=groups)
    fit.absorbed = groups
    return fit


def _fit_ml(estimator, df: DataFrame, y: str, x, weight=None):
    """Fits a Spark ML estimator on the complete rows; they are kept while it iterates."""
    extra = [num(weight).alias("_w")] if weight else []
    rows = df.select(num(y).alias("_y"), *[num(c).alias(f"_x{i}") for i, c in enumerate(x)], *extra)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(x))], outputCol="_f")
        return estimator.fit(assembler.transform(rows.dropna()))
    finally:
        rows.unpersist()


def glm(df: DataFrame, y: str, x, family: str, link: str | None = None, weight: str | None = None) -> DataFrame:
    """Generalised linear model by Spark ML: ``term, coef, se, t, p``."""
    model = GeneralizedLinearRegression(
        family=family, link=link or {"binomial": "logit", "poisson": "log", "gamma": "log", "gaussian": "identity"}[family],
        labelCol="_y", featuresCol="_f", maxIter=50, tol=1e-10,
    )
    if weight:
        model = model.setWeightCol("_w")
    got = _fit_ml(model, df, y, x, weight)
    s = got.summary
    order = [len(x), *range(len(x))]  # Spark lists the intercept last
    coefs = [*got.coefficients.toArray(), got.intercept]
    rows = [
        (([*x, CONST])[i], float(coefs[i]), float(s.coefficientStandardErrors[i]), float(s.tValues[i]), float(s.pValues[i]))
        for i in order
    ]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double")


def penalized(df: DataFrame, y: str, x, strength: float, mix: float = 0.0, weight: str | None = None) -> DataFrame:
    """Ridge (``mix`` 0), lasso (1) or elastic net on the moment matrix: ``term, coef`` and ``kkt``, the violated part of each coefficient's condition."""
    return net_path(df, y, x, [strength], mix, weight).select("term", "coef", "kkt")


def predict(fit: Fit, df: DataFrame, level: float = 0.95) -> DataFrame:
    """Rows with the prediction and its interval for a new observation.

    After a weighted fit the new observation has the weight of its row: its variance is s2 / w.
    """
    if fit.absorbed:
        raise ValueError("a fit with absorbed groups has no intercept to predict with")
    spread = F.lit(fit.rss / fit.df_resid) * (1 + fit.leverage())
    spread = ratio(spread, num(fit.weight)) if fit.weight else spread
    half = F.lit(float(dist.t_critical(level, float(fit.df_resid)))) * F.sqrt(spread)
    return df.withColumn("predicted", fit.fitted()).withColumns(
        {"pred_lo": F.col("predicted") - half, "pred_hi": F.col("predicted") + half}
    )


def errors(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """RMSE, MAE, MAPE (rows with ``y = 0`` left out of MAPE) and R squared."""
    gap = num(y) - num(predicted)
    both = F.when(gap.isNotNull(), num(y))
    return df.agg(
        F.count(gap).alias("n"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.avg(F.abs(F.try_divide(gap, num(y)))).alias("mape"),
        (1 - ratio(F.avg(gap * gap), F.var_pop(both))).alias("r2"),
    )


def factor_effects(fit: Fit, spark: SparkSession, logged: bool = True) -> DataFrame:
    """What each factor does: coefficient, percent effect, standardised coefficient
    and contribution ``beta cov(x, y) / var(y)``; contributions add up to R squared."""
    sxx = np.sqrt(np.diag(fit.m.block(fit.x, fit.x)))
    sxy = fit.m.block(fit.x, [fit.y])[:, 0]
    rows = [
        (c, float(b), 100 * math.expm1(b) if logged else None, float(b * s / math.sqrt(fit.tss)), float(b * v / fit.tss))
        for c, b, s, v in zip(fit.x, fit.slopes, sxx, sxy)
    ]
    return spark.createDataFrame(
        rows, "term string, coef double, percent_effect double, beta_std double, contribution double"
    )


def design(df: DataFrame, y: str, terms, max_levels: int = 200) -> tuple[DataFrame, list]:
    """Regression columns from a list of terms, and their names.

    A term is a column name, ``("log", c)``, ``("pow", c, p)``, ``("inter", a, b)``
    or ``("dummy", c)`` / ``("dummy", c, base)``. ``y`` may be ``("log", c)`` too;
    it becomes column ``y``. The base level is the most frequent one by default.
    """
    def single(t):
        if isinstance(t, str):
            return t, num(t)
        if t[0] == "log":
            return f"ln_{t[1]}", F.when(num(t[1]) > 0, F.ln(num(t[1])))
        if t[0] == "pow":
            return f"{t[1]}_{t[2]}", F.pow(num(t[1]), F.lit(float(t[2])))
        return f"{t[1]}_x_{t[2]}", num(t[1]) * num(t[2])

    added = {"y": single(y)[1]}
    for t in terms:
        if not isinstance(t, str) and t[0] == "dummy":
            c = t[1]
            counts = df.where(F.col(c).isNotNull()).groupBy(c).count()
            found = counts.orderBy(F.desc("count"), c).limit(max_levels + 1).collect()
            if len(found) > max_levels:
                raise ValueError(f"{c} has more than {max_levels} levels: lump the rare ones first")
            base = t[2] if len(t) > 2 else found[0][c]
            for level in sorted(r[c] for r in found if r[c] != base):
                added[f"{c}={level}"] = (F.col(c) == F.lit(level)).cast("double")
        else:
            name, c = single(t)
            added[name] = c
    names = [n for n in added if n != "y"]
    # a name such as "kind=a.b" is not a column path: keep plain letters
    safe = {n: "".join(ch if ch.isalnum() or ch in "_=" else "_" for ch in n) for n in names}
    if len(set(safe.values())) < len(safe):
        raise ValueError("two terms would get the same name")
    return df.withColumns({safe.get(n, n): c for n, c in added.items()}), [safe[n] for n in names]
