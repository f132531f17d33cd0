"""Linear support vector machines by Newton's method on a rounded hinge, with a proof of how near the optimum they are.

The hinge ``max(0, 1 - m)`` gets a quadratic corner of a given width, so that every row has a definite dual weight: the slope of its loss.
One scan adds up loss, slope and curvature, and by class the dual weights and their moments. The heavier class's weights are scaled
down until both classes weigh the same, which the free intercept demands; they are then feasible for the dual, and the
dual's value bounds the optimum from below. What travels is some sums of the size of columns squared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.operators.newton import matrix


LENGTHS = [0.5**i for i in range(10)]  # parts of a Newton step that one scan tries


@dataclass
class Margin:
    """A fitted machine; ``beta`` holds the intercept and the coefficients of the prepared columns.

    ``primal`` is the criterion, mean loss plus ``penalty``/2 times the squared length of the coefficients; the optimum lies between ``dual`` and ``primal``.
    """

    centre: np.ndarray
    scale: np.ndarray
    penalty: float
    beta: np.ndarray
    width: float
    rows: int
    primal: float
    dual: float
    converged: bool
    steps: int

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return prepared(x, self.centre, self.scale)

    def coefficients(self) -> np.ndarray:
        """Intercept and slopes of the columns as they are."""
        slopes = np.divide(self.beta[1:], self.scale, out=np.zeros(len(self.scale)), where=self.scale > 0)
        return np.concatenate([[self.beta[0] - slopes @ self.centre], slopes])


def prepared(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A column of ones and the columns centred and scaled; a missing value counts as the centre, a column of scale 0 as 0."""
    z = np.where(np.isfinite(x), x, centre) - centre
    z = np.divide(z, scale, out=np.zeros_like(z), where=scale > 0)
    return np.hstack([np.ones((len(z), 1)), z])


def sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, betas: list[np.ndarray], width: float) -> list[dict[str, np.ndarray]]:
    """Everything a step and its certificate need, at each of ``betas``, in one scan."""
    k = len(betas[0])
    parts = {"weight": 1, "hinge": 1, "loss": 1, "square": 2, "up": k, "down": k, "curve": k * k, "wide": k * k}
    size = sum(parts.values())

    def run(batches):
        total = np.zeros((len(betas), size))
        for batch in batches:
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            own = w > 0
            y, w, z = 2 * y[own] - 1, w[own], prepared(matrix(batch, len(scale))[own], centre, scale)
            for t, beta in zip(total, betas, strict=True):
                short = 1 - y * (z @ beta)  # what a row lacks to the margin
                dual = np.clip(short / width, 0, 1)
                inside = w * ((short > 0) & (short < width)) / width
                around = w * ((short > -4 * width) & (short < 5 * width)) / width
                up, down = (w * dual)[y > 0], (w * dual)[y < 0]
                t += np.concatenate([
                    [w.sum(), w @ np.maximum(short, 0), w @ (dual * (short - width * dual / 2)), up @ dual[y > 0], down @ dual[y < 0]],
                    up @ z[y > 0], down @ z[y < 0], ((z * inside[:, None]).T @ z).ravel(), ((z * around[:, None]).T @ z).ravel(),
                ])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    got = np.zeros(len(betas) * size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # some numbers per pair of columns
        got[r["i"]] = r["v"]
    ends = np.cumsum(list(parts.values()))
    return [{name: g[end - n : end] for (name, n), end in zip(parts.items(), ends, strict=True)} for g in got.reshape(len(betas), size)]


def bounds(s: dict[str, np.ndarray], beta: np.ndarray, penalty: float, width: float) -> tuple[float, float, float]:
    """Criterion with the rounded loss, and a lower bound of its optimum and of the plain hinge's."""
    n = s["weight"][0]
    criterion = s["loss"][0] / n + penalty / 2 * float(beta[1:] @ beta[1:])
    totals = s["up"][0], s["down"][0]  # the first column is one: sums of the dual weights
    level = min(totals)
    up, down = (level / v if v > 0 else 0.0 for v in totals)
    pull = (up * s["up"][1:] - down * s["down"][1:]) / n
    plain = 2 * level / n - float(pull @ pull) / (2 * penalty)
    return criterion, plain - width / 2 * float(up**2 * s["square"][0] + down**2 * s["square"][1]) / n, plain


def fit(
    rows: DataFrame, centre, scale, penalty: float, width: float | None = None, tol: float = 1e-6, most: int = 200
) -> Margin:
    """Fits on ``rows`` (as ``newton.batches_of`` makes them; weights of 0 have no part), read once a step, so write them first.

    With ``width`` the loss is the hinge rounded over that width. Without it the plain hinge is meant: the width shrinks from 1
    until primal and dual differ by no more than ``tol`` of the primal. ``converged`` says whether they do. A table without rows, or a penalty that is not
    positive, is an error; rows of one class only are fitted by the intercept alone.
    """
    if not penalty > 0:
        raise ValueError("the penalty must be positive")
    centre, scale = np.asarray(centre, float), np.asarray(scale, float)
    k = len(scale) + 1
    ridge = np.concatenate([[0.0], np.full(k - 1, float(penalty))])
    corner, base, least, ways, kept = (width or 1.0), np.zeros(k), np.inf, [], None
    for steps in range(1, most + 1):
        betas = [base + step * length for step in ways for length in LENGTHS] or [base]
        tried = sums(rows, centre, scale, betas, corner)
        n = tried[0]["weight"][0]
        if n <= 0:
            raise ValueError("no training rows")
        found = [bounds(s, beta, penalty, corner) for s, beta in zip(tried, betas, strict=True)]
        best = min(range(len(betas)), key=lambda i: found[i][0])
        beta, s, (criterion, low, plain) = betas[best], tried[best], found[best]
        hinge = s["hinge"][0] / n + penalty / 2 * float(beta[1:] @ beta[1:])
        primal, dual = map(float, (criterion, low) if width else (hinge, plain))
        if kept is None or primal - dual < kept.primal - kept.dual:
            kept = Margin(centre, scale, penalty, beta, corner, int(round(n)), primal, dual, primal - dual <= tol * max(primal, tol), steps)
        if kept.converged:
            break
        better = criterion < least - 1e-15
        if better:
            base, least = beta, criterion
        if not width and (not better or criterion - low <= 0.1 * (primal - dual)):  # the corner, not the step, keeps the bounds apart
            corner, least, ways = corner / 4, np.inf, []
            continue
        if not better:
            break
        slope = (s["up"] - s["down"]) / n - ridge * beta
        # rows that leave the corner take their curvature along: that of the rows around it gives a shorter, safer step
        curves = [s[c].reshape(k, k) / n + np.diag(ridge) + 1e-9 * np.eye(k) for c in ("curve", "wide")]
        ways = [step * min(1.0, 4 / max(np.abs(step).max(), 1e-300)) for step in (np.linalg.solve(c, slope) for c in curves)]
    kept.steps = steps
    return kept


def scored(rows: DataFrame, model: Margin) -> DataFrame:
    """``(y, g, score)`` of every row: the margin of the positive class."""

    def run(batches):
        for batch in batches:
            z = model.prepare(matrix(batch, len(model.scale)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("g"), pa.array(z @ model.beta)], ["y", "g", "score"])

    return rows.mapInArrow(run, "y double, g int, score double")
