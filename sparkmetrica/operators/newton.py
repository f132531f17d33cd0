"""Logistic regressions by Newton's method, many models in every scan.

A model is a training mask, a linear preparation of its own (filling, centring, scaling) and a penalty. One scan adds up loss, slope and
curvature of all models at once: each partition sends one sum per number, so what travels doesn't grow with its rows. A fit ends
where the slope vanishes, and says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Logit:
    """One model: rows whose ``group`` is not ``without`` train it. ``fill``, ``centre`` and ``scale`` prepare each column.

    A column of scale 0 has no part in it. The criterion is the mean loss plus ``penalty``/2 times the squared length of the prepared coefficients.
    """

    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    penalty: float = 0.0
    without: int | None = None
    beta: np.ndarray = field(default=None)
    slope: float = float("inf")  # largest element of the gradient of the criterion
    loss: float = float("nan")  # mean loss of the training rows
    rows: int = 0
    converged: bool = False

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """A column of ones and the prepared columns."""
        z = np.where(np.isfinite(x), x, self.fill) - self.centre
        z = np.divide(z, self.scale, out=np.zeros_like(z), where=self.scale > 0)
        return np.hstack([np.ones((len(z), 1)), z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prepare(x) @ self.beta, -700, 700)))

    def coefficients(self) -> np.ndarray:
        """Intercept and slopes of the columns as they are."""
        slopes = np.divide(self.beta[1:], self.scale, out=np.zeros(len(self.scale)), where=self.scale > 0)
        return np.concatenate([[self.beta[0] - slopes @ self.centre], slopes])


def batches_of(rows: DataFrame, columns, label: str, group: str | None, weight: str | None, keep=()) -> DataFrame:
    """``y, g, w`` and the vector ``x`` of a row; a row without label has no part. Missing values stay NaN for the models to fill."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    return rows.where(F.col(label).isNotNull()).select(
        *keep, F.col(label).cast("double").alias("y"), (F.col(group) if group else F.lit(-1)).cast("int").alias("g"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.array(*[value(c) for c in columns]).alias("x"),
    )


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(rows: DataFrame, models: list[Logit]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Weight, loss, slope and curvature of every model at its ``beta``, in one scan."""
    width = len(models[0].scale)
    size = 2 + (width + 1) + (width + 1) ** 2

    def run(batches):
        total = np.zeros((len(models), size))
        for batch in batches:
            y, g, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "g", "w"))
            x = matrix(batch, width)
            for t, model in zip(total, models, strict=True):
                own = w > 0 if model.without is None else (w > 0) & (g != model.without)
                z, target, weight = model.prepare(x[own]), y[own], w[own]
                eta = np.clip(z @ model.beta, -700, 700)
                p, q = 1 / (1 + np.exp(-eta)), 1 / (1 + np.exp(eta))  # both exact near 0, so that curvature never rounds to 0
                t[0] += weight.sum()
                t[1] += weight @ (np.logaddexp(0, eta) - target * eta)
                t[2 : 3 + width] += z.T @ (weight * (target * q - (1 - target) * p))
                t[3 + width :] += ((z * (weight * p * q)[:, None]).T @ z).ravel()
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    got = np.zeros(len(models) * size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # some numbers per model
        got[r["i"]] = r["v"]
    got = got.reshape(len(models), size)
    return [(t[0], t[1], t[2 : 3 + width], t[3 + width :].reshape(width + 1, width + 1)) for t in got]


def fit(rows: DataFrame, models: list[Logit], tol: float = 1e-10, most: int = 60) -> list[Logit]:
    """Fits all models together; ``rows`` (as :func:`batches_of` makes them) are read once a step, so write them first.

    Each model takes full Newton steps and halves one that made its criterion worse. Those that are done leave the scan. A model whose
    classes can be parted without penalty has no optimum and ends unconverged.
    """
    ridge = lambda m: np.concatenate([[0.0], np.full(len(m.scale), m.penalty)])
    state = {}
    for m in models:
        m.beta, m.converged = np.zeros(len(m.scale) + 1), False
        state[id(m)] = (m.beta, np.inf, np.zeros_like(m.beta))
    open_models = list(models)
    for _ in range(most):
        if not open_models:
            break
        for m, (weight, loss, slope, curve) in zip(open_models, sums(rows, open_models), strict=True):
            if weight <= 0:
                raise ValueError("a model has no training rows")
            best, least, step = state[id(m)]
            criterion = loss / weight + m.beta @ (ridge(m) * m.beta) / 2
            if criterion > least + 1e-14 * max(1.0, abs(least)):
                step = step / 2
                state[id(m)] = (best, least, step)
                m.beta = best + step
                continue
            down = slope / weight - ridge(m) * m.beta
            m.slope, m.loss, m.rows = float(np.abs(down).max()), float(loss / weight), int(round(weight))
            step = np.linalg.lstsq(curve / weight + np.diag(ridge(m)), down, rcond=None)[0]
            # Where classes can be parted the slope vanishes as well, but with the curvature: the next step stays long.
            m.converged = m.slope <= tol and float(np.abs(step).max()) <= 1e-6 * (1 + float(np.abs(m.beta).max()))
            if not m.converged:
                state[id(m)] = (m.beta, criterion, step)
                m.beta = m.beta + step
        open_models = [m for m in open_models if not m.converged]
    for m in open_models:
        m.beta = state[id(m)][0]
    return models


def scored(rows: DataFrame, models: list[Logit], held_out: bool, keep: str = "") -> DataFrame:
    """``(model, y, score)`` of every row and model, or with ``held_out`` of the rows that the model wasn't trained on.

    ``keep`` declares columns of ``rows`` that go with the answer, e.g. ``"id long"``.
    """
    width = len(models[0].scale)
    kept = [c.split()[0] for c in keep.split(",") if c.strip()]

    def run(batches):
        for batch in batches:
            g, x = batch.column("g").to_numpy(zero_copy_only=False), matrix(batch, width)
            for number, model in enumerate(models):
                own = np.flatnonzero(g == model.without) if held_out else np.arange(len(g))
                if len(own):
                    part = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in kept), pa.array(np.full(len(own), number, np.int32)), part.column("y"), pa.array(model.probability(x[own]))],
                        [*kept, "model", "y", "score"],
                    )

    return rows.mapInArrow(run, (keep + ", " if kept else "") + "model int, y double, score double")
