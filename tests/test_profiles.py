"""Exact distinct counts, mergeable sketches, best subsets and values that are no numbers, against brute force."""

import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import regression as R
from sparkmetrica.operators import subset as S
from sparkmetrica.operators import tables as X
from sparkmetrica.operators.moments import moments
from sparkmetrica.session import settle


def test_distinct_counts_of_every_type(spark):
    day = datetime.date(2020, 1, 1)
    rows = [
        (i % 50_000, i % 3 - 10**15, (i * 2**40) % (2**62) - 2**61, None if i % 5 else i % 11, day + datetime.timedelta(days=i % 400), [0.0, -0.0, float("nan"), 1.5, None][i % 5], f"s{i % 13}" if i % 13 else None, i % 2 == 0, bytes([i % 7]), [i % 4], None)
        for i in range(2000)
    ]
    names = ["near", "low", "far", "gaps", "day", "number", "text", "flag", "raw", "list", "none"]
    df = spark.createDataFrame(rows, "near long, low long, far long, gaps int, day date, number double, text string, flag boolean, raw binary, list array<int>, none int").repartition(3)
    got = {r["column"]: r["distinct"] for r in X.distinct_counts(X.nan_to_null(df)).collect()}
    want = {c: len({str(r[i] + 0.0) if c == "number" else str(r[i]) for r in rows if r[i] is not None and r[i] == r[i]}) for i, c in enumerate(names)}
    assert got == want
    assert {r["column"]: r["distinct"] for r in X.profile(df, names[:8], exact=True).collect()} == {c: want[c] for c in names[:8]}
    assert {r["distinct"] for r in X.distinct_counts(df.where("false")).collect()} == {0}


def test_dense_integers_travel_as_bitmaps(spark):
    """200 000 distinct numbers over 32 768 a bitmap: eight rows a task leave the first aggregation, not one a value."""
    df = spark.range(200_000).select((F.col("id") - 1000).alias("x"), (F.col("id") * 1_000_003).alias("y"))
    assert [r["distinct"] for r in X.distinct_counts(df).collect()] == [200_000, 200_000]
    place = F.col("x") + 1001
    bits = df.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    assert bits.count() == 7 and bits.agg(F.sum(F.bitmap_count("bits"))).first()[0] == 200_000


def test_sketches_of_parts_merge_into_one_of_the_whole(spark):
    rng = np.random.default_rng(9)
    table = [(int(i % 30), "abc"[i % 3], None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.lognormal(size=30_000))]
    df = spark.createDataFrame(table, "day int, kind string, v double").repartition(5)
    daily = settle(X.quantile_sketches(df, "v", ["day", "kind"]))
    probs = (0.01, 0.25, 0.5, 0.9, 0.999)
    for by in (["kind"], []):
        for r in X.sketch_quantiles(X.merge_sketches(daily, by), probs).collect():
            v = np.array([x for _, k, x in table if x is not None and (not by or k == r["kind"])])
            assert (r["n"], r["min"], r["max"]) == (len(v), v.min(), v.max())
            for p in probs:
                q = r[X.O.quantile_name(p)]
                assert np.mean(v < q) - X.kll_error() <= p <= np.mean(v <= q) + X.kll_error()
    empty = X.sketch_quantiles(X.quantile_sketches(df.where("v IS NULL"), "v", ["kind"]))
    assert [(r["n"], r["q50"]) for r in empty.collect()] == [(0, None)] * 3


@pytest.mark.parametrize("seed", range(3))
def test_best_subsets_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    k, n = 10, 200
    x = rng.normal(size=(n, k))
    x[:, 1] += 0.9 * x[:, 0]
    x[:, 5] -= x[:, 2] + x[:, 3]
    y = x[:, 0] - 2 * x[:, 5] + 0.3 * x[:, 7] + rng.normal(size=n)
    x, y = x - x.mean(0), y - y.mean()
    found, looked = S.best_by_size(x.T @ x, x.T @ y, float(y @ y))
    assert looked < 2**k
    for size in range(k + 1):
        least = min((float(np.sum((y - (x[:, c] @ np.linalg.lstsq(x[:, c], y, rcond=None)[0] if c else 0)) ** 2)), c) for c in map(list, combinations(range(k), size)))
        assert found[size][0] == pytest.approx(least[0], rel=1e-9) and list(found[size][1]) == least[1]


def test_best_subset_leaves_out_what_says_nothing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    rows = [(*map(float, r), float(2 * r[0] - r[2] + e)) for r, e in zip(x, rng.normal(size=500), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").withColumns({"twice": 2 * F.col("a"), "one": F.lit(1.0)})
    got = {r["size"]: r for r in S.best_subset(df, "y", ["a", "b", "c", "twice", "one"]).collect()}
    assert set(got) == {0, 1, 2, 3} and got[2]["best"] and got[2]["terms"] == "a,c"
    fit = R.ols(df, "y", ["a", "c"])
    assert got[2]["rss"] == pytest.approx(fit.rss, rel=1e-9)


@pytest.mark.parametrize("k", [3, 30])
def test_values_that_are_no_numbers_are_missing_on_narrow_and_wide_tables(spark, k):
    """The same rows are left out whichever way the sums are taken."""
    odd = {0: float("inf"), 1: float("-inf"), 2: float("nan"), 3: None}
    rows = [[odd.get(i, float(i)) if j == 1 else float((i * (j + 3)) % 17) for j in range(k)] for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(k)))
    m = moments(df, [f"x{j}" for j in range(k)])
    x = np.array(rows[4:], float)
    assert (m.n, m.n_total) == (56, 60)
    assert np.allclose(m.s, (x - x.mean(0)).T @ (x - x.mean(0)))
