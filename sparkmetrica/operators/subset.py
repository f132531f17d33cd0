"""Best subsets of regressors by leaps and bounds on the moment matrix.

All models are subsets of one matrix of sums, so the rows are scanned once. The search starts from all regressors and leaves them out one by
one. From the inverse ``A`` of the sums and the coefficients ``b`` of a model follows at once what each omission costs, ``b_i^2 / A_ii``,
and the inverse without it. A model's residual sum is a lower bound for all models inside it, so a branch that can't beat the best of
any size it leads to is cut.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from sparkmetrica.functions.scalars import num
from sparkmetrica.operators.moments import moments
from sparkmetrica.operators.regression import independent


def best_by_size(cross: np.ndarray, with_y: np.ndarray, total: float) -> tuple[dict, int]:
    """``size -> (residual sum, columns)`` of the best model of each size, and the models looked at.

    ``cross`` are the centred sums of the columns (no collinear ones), ``with_y`` those with the outcome, ``total`` that of the outcome.
    """
    scale = np.sqrt(np.diag(cross))
    inverse = np.linalg.inv(cross / np.outer(scale, scale))
    slopes = inverse @ (with_y / scale)
    # The columns that matter most come first: branches that lose one of them are large, and cut at once.
    order = np.argsort(-(slopes**2 / np.diag(inverse)), kind="stable")
    inverse, slopes = inverse[np.ix_(order, order)], slopes[order]
    rss = total - slopes @ (with_y / scale)[order]
    best: dict[int, tuple[float, tuple]] = {0: (total, ())}
    looked = 0
    stack = [(rss, tuple(order.tolist()), inverse, slopes, 0)]
    while stack:
        rss, names, a, b, start = stack.pop()
        looked += 1
        if len(names) not in best or rss < best[len(names)][0]:
            best[len(names)] = (rss, tuple(sorted(names)))
        # the first `start` columns stay, so this branch leads to sizes from `start` to one less than its own
        if all(size in best and best[size][0] <= rss for size in range(start, len(names))):
            continue
        for i in range(start, len(names)):
            stay = [j for j in range(len(names)) if j != i]
            less = a[np.ix_(stay, stay)] - np.outer(a[stay, i], a[i, stay]) / a[i, i]
            child = (rss + b[i] ** 2 / a[i, i], tuple(names[j] for j in stay), less, b[stay] - a[stay, i] * b[i] / a[i, i], i)
            if not all(size in best and best[size][0] <= child[0] for size in range(i, len(names))):
                stack.append(child)
    return best, looked


def best_subset(df: DataFrame, y: str, x, criterion: str = "bic") -> DataFrame:
    """The best linear model of every size: ``size, terms, n, rss, r2, aic, bic, best``; ``best`` marks the least ``aic`` or ``bic``.

    One scan. Constant and collinear columns are left out. Rows with a missing value have no part. Some 30 regressors are
    within reach; with noise columns only, the bounds cut little and the work doubles with each.
    """
    x = list(x)
    m = moments(df, {c: num(c) for c in [y, *x]})
    kept = [x[i] for i in independent(m.block(x, x))]
    total = float(m.block([y], [y])[0, 0])
    found, _ = best_by_size(m.block(kept, kept), m.block(kept, [y])[:, 0], total) if kept else ({0: (total, ())}, 0)
    rows = []
    for size, (rss, columns) in sorted(found.items()):
        rss = max(float(rss), 0.0)
        fit = m.n * (math.log(2 * math.pi * rss / m.n) + 1) if rss > 0 else -math.inf
        rows.append((size, ",".join(sorted((kept[i] for i in columns), key=x.index)), m.n, rss, 1 - rss / total if total > 0 else None, fit + 2 * (size + 1), fit + math.log(m.n) * (size + 1)))
    at = {"aic": 5, "bic": 6}[criterion]
    least = min(r[at] for r in rows)
    schema = "size int, terms string, n bigint, rss double, r2 double, aic double, bic double, best boolean"
    return df.sparkSession.createDataFrame([(*r, bool(r[at] == least)) for r in rows], schema)
