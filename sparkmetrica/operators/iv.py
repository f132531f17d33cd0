"""Endogeneity: instrumental variables and their tests.

Everything except robust covariances follows from one moment matrix of
``[y, exogenous, endogenous, instruments]``: a single scan of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmetrica.functions import dist
from sparkmetrica.operators.moments import Moments, moments, pair_sums
from sparkmetrica.operators.regression import Fit, fit_moments, inverse_of, variables, _keep


@dataclass
class IvModel:
    """Columns and moments shared by the estimator and its tests."""

    y: str
    exog: list
    endog: list
    instruments: list
    columns: dict
    m: Moments

    @property
    def x(self) -> list:
        return [*self.exog, *self.endog]

    @property
    def z(self) -> list:
        return [*self.exog, *self.instruments]


def iv_model(df: DataFrame, y: str, exog, endog, instruments) -> IvModel:
    exog, endog, instruments = list(exog), list(endog), list(instruments)
    columns = variables([y, *exog, *endog, *instruments])
    m = moments(df, columns)
    kept, _ = _keep(m, [*exog, *instruments])
    exog, instruments = [c for c in exog if c in kept], [c for c in instruments if c in kept]
    if len(instruments) < len(endog):
        raise ValueError("fewer independent instruments than endogenous regressors")
    return IvModel(y, exog, endog, instruments, columns, m)


def iv2sls(model: IvModel) -> Fit:
    """Two-stage least squares. Robust and clustered errors: ``regression.robust_cov``
    and ``cluster_cov`` of the returned fit."""
    m = model.m
    szx, szy = m.block(model.z, model.x), m.block(model.z, [model.y])[:, 0]
    projection = inverse_of(m.block(model.z, model.z)) @ szx
    inverse = inverse_of(szx.T @ projection)
    slopes = inverse @ (projection.T @ szy)
    sxx, sxy = m.block(model.x, model.x), m.block(model.x, [model.y])[:, 0]
    rss = float(m.block([model.y], [model.y])[0, 0] - 2 * slopes @ sxy + slopes @ sxx @ slopes)
    return Fit(
        model.y, model.x, model.columns, m, slopes, inverse, rss, m.n - len(model.x) - 1,
        projection=projection, z=model.z,
    )


def _rss(s: np.ndarray, target: int, on: list[int]) -> float:
    if not on:
        return float(s[target, target])
    cross = s[np.ix_(on, [target])][:, 0]
    return float(s[target, target] - cross @ inverse_of(s[np.ix_(on, on)]) @ cross)


def first_stage(model: IvModel, spark: SparkSession) -> DataFrame:
    """Strength of the instruments for each endogenous regressor: partial F and R squared."""
    m, q = model.m, len(model.instruments)
    freedom = m.n - len(model.z) - 1
    rows = []
    for name in model.endog:
        at = m.at([name])[0]
        short, full = _rss(m.s, at, m.at(model.exog)), _rss(m.s, at, m.at(model.z))
        f = ((short - full) / q) / (full / freedom)
        rows.append((name, f, q, freedom, float(dist.f_tail(f, q, freedom)), 1 - full / short))
    return spark.createDataFrame(rows, "endog string, f double, df1 bigint, df2 bigint, p double, partial_r2 double")


def dwh_test(model: IvModel) -> dict:
    """Durbin-Wu-Hausman: first-stage residuals added to the structural equation.

    The augmented moment matrix is a linear map of the one at hand, so the
    residuals are never computed row by row.
    """
    m = model.m
    pi = inverse_of(m.block(model.z, model.z)) @ m.block(model.z, model.endog)
    order = [model.y, *model.x]
    lift = np.zeros((len(order) + len(model.endog), len(m.names)))
    for i, name in enumerate(order):
        lift[i, m.at([name])[0]] = 1.0
    for j, name in enumerate(model.endog):
        row = len(order) + j
        lift[row, m.at([name])[0]] = 1.0
        for i, z in enumerate(model.z):
            lift[row, m.at([z])[0]] -= pi[i, j]
    s = lift @ m.s @ lift.T
    base = list(range(1, len(order)))
    d1 = len(model.endog)
    d2 = m.n - len(s)
    short, full = _rss(s, 0, base), _rss(s, 0, [*base, *range(len(order), len(s))])
    f = ((short - full) / d1) / (full / d2)
    return {"f": f, "df1": d1, "df2": d2, "p": float(dist.f_tail(f, d1, d2))}


def overid_test(model: IvModel, df: DataFrame | None = None) -> dict:
    """Over-identification: Sargan, or Hansen's J (two-step GMM) when ``df`` is given."""
    extra = len(model.instruments) - len(model.endog)
    if extra <= 0:
        raise ValueError("the model is exactly identified: nothing to test")
    m, fit = model.m, iv2sls(model)
    szx, szy = m.block(model.z, model.x), m.block(model.z, [model.y])[:, 0]
    if df is None:
        g = szy - szx @ fit.slopes
        stat = float(m.n * (g @ inverse_of(m.block(model.z, model.z)) @ g) / fit.rss)
        kind = "sargan"
    else:
        means = m.means(model.z)
        moves = [fit.residual() * (model.columns[c] - F.lit(float(v))) for c, v in zip(model.z, means)]
        rows = fit.rows(df, **{f"_g{i}": c for i, c in enumerate(moves)})
        weight = inverse_of(pair_sums(rows, [F.col(c) for c in rows.columns]))
        slopes = np.linalg.solve(szx.T @ weight @ szx, szx.T @ weight @ szy)
        g = szy - szx @ slopes
        stat = float(g @ weight @ g)
        kind = "hansen_j"
    return {"test": kind, "stat": stat, "df": extra, "p": float(dist.chi2_tail(stat, extra))}


def ols_counterpart(model: IvModel) -> Fit:
    """OLS on the same rows, to compare with the 2SLS slopes."""
    return fit_moments(model.m, model.y, model.x, model.columns)
