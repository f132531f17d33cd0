"""Penalised linear models on the moment matrix: one scan serves every penalty.

With all columns in units of their standard deviations the criterion is

    1/2 (1 - 2 r'b + b'Rb) + l1 |b|_1 + l2/2 b'b,    l1 = s mix / sd(y),  l2 = s (1 - mix) / sd(y)

for a strength ``s``, so the correlations ``R`` and ``r`` say all there is to know about the rows. Coordinate descent runs on
them, and every answer comes with what proves it: how far it is from the conditions of the optimum, and the duality gap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sparkmetrica.functions.scalars import num
from sparkmetrica.operators.moments import Moments, moments

CONST = "const"


@dataclass
class Net:
    """One fitted penalty. ``kkt`` is the largest violation of a condition of the optimum, ``gap`` bounds the distance of the criterion."""

    strength: float
    names: list
    slopes: np.ndarray
    intercept: float
    kkt: np.ndarray
    gap: float
    r2: float
    steps: int


def soft(v: float, by: float) -> float:
    return np.sign(v) * max(abs(v) - by, 0.0)


def descend(corr: np.ndarray, cross: np.ndarray, l1: float, l2: float, start: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, int]:
    """Cyclic coordinate descent until no condition is missed by more than ``tol``."""
    b = start.copy()
    rest = cross - corr @ b  # correlation of each column with the residual
    for step in range(1, most + 1):
        for j in range(len(b)):
            new = soft(rest[j] + corr[j, j] * b[j], l1) / (corr[j, j] + l2)
            if new != b[j]:
                rest -= corr[:, j] * (new - b[j])
                b[j] = new
        rest = cross - corr @ b
        if violations(rest, b, l1, l2).max(initial=0.0) <= tol:
            break
    return b, step if len(b) else 0


def violations(rest: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """How far each coefficient is from its condition: the slope of the criterion, or what of it a zero doesn't absorb."""
    slope = rest - l2 * b
    return np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0.0))


def duality_gap(corr: np.ndarray, cross: np.ndarray, b: np.ndarray, l1: float, l2: float) -> float:
    """Criterion at ``b`` less the best lower bound that its scaled residual gives."""
    rss = 1 - 2 * cross @ b + b @ corr @ b + l2 * b @ b
    top = np.abs(cross - corr @ b - l2 * b).max(initial=0.0)
    scale = 1.0 if top <= l1 else l1 / top
    return float(rss / 2 + l1 * np.abs(b).sum() - (scale * (1 - cross @ b) - scale * scale * rss / 2))


def path(m: Moments, y: str, x, strengths, mix: float, tol: float = 1e-12, most: int = 100_000) -> list[Net]:
    """Fits for all strengths, the strongest first as each starts where the last one ended; the answer is in the order given.

    Columns without variation get coefficient 0. ``mix`` 0 is ridge, solved directly; 1 is the lasso.
    """
    x = list(x)
    sd_all = np.sqrt(np.maximum(np.diag(m.block(x, x)), 0.0) / m.weight)
    sd_y = float(np.sqrt(max(m.block([y], [y])[0, 0], 0.0) / m.weight))
    used = [i for i, s in enumerate(sd_all) if s > 1e-14 * max(1.0, abs(m.means(x)[i])) and sd_y > 0]
    names, sd = [x[i] for i in used], sd_all[used]
    corr = m.block(names, names) / m.weight / np.outer(sd, sd)
    cross = m.block(names, [y])[:, 0] / m.weight / (sd * sd_y) if used else np.zeros(0)
    found, b = {}, np.zeros(len(used))
    for strength in sorted(set(strengths), reverse=True):
        l1, l2 = (strength * p / sd_y if sd_y else 0.0 for p in (mix, 1 - mix))
        if l1 == 0:  # least squares or ridge: least norm if columns are collinear
            b, steps = np.linalg.lstsq(corr + l2 * np.eye(len(b)), cross, rcond=None)[0] if used else b, 1
        else:
            b, steps = descend(corr, cross, l1, l2, b, tol, most)
        slopes, kkt = np.zeros(len(x)), np.zeros(len(x))
        slopes[used] = b * sd_y / sd if used else b
        kkt[used] = violations(cross - corr @ b, b, l1, l2)
        gap = duality_gap(corr, cross, b, l1, l2) if l1 else 0.0
        fit = 2 * cross @ b - b @ corr @ b
        found[strength] = Net(strength, x, slopes, float(m.means([y])[0] - m.means(x) @ slopes), kkt, gap, float(fit), steps)
    return [found[s] for s in strengths]


def strongest(m: Moments, y: str, x, mix: float) -> float:
    """The least strength at which every coefficient of a net with ``mix`` > 0 is zero."""
    sd = np.sqrt(np.diag(m.block(x, x)) / m.weight)
    cross = np.abs(m.block(x, [y])[:, 0]) / m.weight
    return float(np.max(np.divide(cross, sd, out=np.zeros_like(sd), where=sd > 0), initial=0.0) / mix)


def net_path(df: DataFrame, y: str, x, strengths=None, mix: float = 0.5, weight: str | None = None, steps: int = 20, least: float = 1e-3) -> DataFrame:
    """``strength, term, coef, kkt, gap, active, r2`` for a whole path of penalties, from one scan of the rows.

    Without ``strengths`` there are ``steps`` of them in equal ratios, from the least one that leaves nothing in the model down to its
    ``least`` part. Rows with a missing value are left out.
    """
    x = list(x)
    m = moments(df, {c: num(c) for c in [y, *x]}, weight)
    if strengths is None:
        top = strongest(m, y, x, mix)
        strengths = [top * least ** (i / max(steps - 1, 1)) for i in range(steps)]
    rows = []
    for fit in path(m, y, x, [float(s) for s in strengths], mix):
        active = int(np.count_nonzero(fit.slopes))
        rows.append((fit.strength, CONST, fit.intercept, 0.0, fit.gap, active, fit.r2))
        rows += [(fit.strength, c, float(b), float(k), fit.gap, active, fit.r2) for c, b, k in zip(x, fit.slopes, fit.kkt, strict=True)]
    return df.sparkSession.createDataFrame(rows, "strength double, term string, coef double, kkt double, gap double, active int, r2 double")
