"""Computed permutations, importance from one order, and bootstrap medians by bracket, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import classify as C
from sparkmetrica.operators import experiment as E
from sparkmetrica.operators import permute as P
from sparkmetrica.session import settle


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 17, 101, 1000, 4999])
def test_every_size_is_permuted(spark, n):
    places = [spark.range(n).select(P.permuted(F.col("id"), n, seed)).collect() for seed in ("a", "b")]
    one, two = ([r[0] for r in p] for p in places)
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 17 or one != two
    if n >= 1000:  # neighbours part, and no place stands out
        assert np.corrcoef(range(n), one)[0, 1] == pytest.approx(0, abs=4 / n**0.5)
        assert np.mean(np.abs(np.diff(one))) == pytest.approx(n / 3, rel=0.1)


def test_grid_holds_all_with_little_to_spare():
    for n in range(1, 3000):
        a, b = P.grid(n)
        assert n <= a * b < n + a


def test_shuffled_columns_are_permutations_with_their_nulls(spark):
    rows = [(i, float(i) if i % 5 else None, f"s{i % 7}" if i % 3 else None, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, flag boolean").repartition(3)
    got = P.shuffled_columns(df, ["x", "kind"], "id", "s", keep=["id", "flag"]).collect()
    assert sorted((r.id, r.x, r.kind, r.flag) for r in got if r.x is not None and r.kind) == sorted(r for r in rows if r[1] is not None and r[2])
    key = lambda v: (v is None, v or 0)
    for c, i in (("x", 1), ("kind", 2)):
        values = [r[f"{c}_new"] for r in got]
        assert sorted(map(str, values)) == sorted(str(r[i]) for r in rows) and values != [r[c] for r in got]
    assert sorted(r.place for r in got) == list(range(300)) and key(None) > key(1)


def test_importance_finds_the_column_that_matters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 2))
    table = [(i, float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-2 * a)))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(table, "id long, a double, b double, label double").repartition(4)
    got = {r.feature: r for r in C.importance(F.col("a") + 0 * F.col("b"), df, ["a", "b"], "id").collect()}
    assert got["b"].importance == pytest.approx(0, abs=1e-12) and got["a"].importance > 0.25
    assert got["a"].auc == pytest.approx(C.auc(df.withColumn("s", F.col("a")), "label", "s").first()["auc"], abs=1e-12)
    assert got["a"].auc_permuted == pytest.approx(0.5, abs=0.06)


def test_one_order_serves_any_number_of_columns(spark):
    df = spark.range(500).select("id", *[(F.col("id") * i % 97).cast("double").alias(f"x{i}") for i in range(1, 7)])
    plans = [P.shuffled_columns(df, [f"x{i}" for i in range(1, k + 1)], "id", "s")._jdf.queryExecution().toString() for k in (1, 6)]
    for plan in plans:  # the order itself is written before, so the plan has one exchange by place
        physical = plan[plan.index("== Physical Plan =="):]
        assert physical.count("hashpartitioning(place") == 1 and physical.count("rangepartitioning") == 0


def weights(rows, B, seed):
    out = {}
    for r in E.weighed_reps(rows, B, seed).collect():
        out.setdefault((r.rep, r.arm), []).extend([r.y] * r.w)
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "few", "skewed"])
def test_bootstrap_medians_are_exact(spark, kind):
    rng = np.random.default_rng(6)
    n = 3 if kind == "few" else 1500
    y = {"spread": rng.normal(size=n), "ties": rng.integers(0, 4, n) * 1.0, "equal": np.full(n, 2.5), "few": np.array([1.0, 4.0, 9.0]), "skewed": np.exp(3 * rng.normal(size=n))}[kind]
    table = [(i, int(i % 3 > 0), float(v)) for i, v in enumerate(y)]
    rows = settle(spark.createDataFrame(table, "unit long, arm int, y double").repartition(4))
    want = {k: float(np.median(v)) for k, v in weights(rows, 30, "s").items() if v}
    got = {(r.rep, r.arm): r["median"] for r in E.bootstrap_medians(rows, 30, "s").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_medians_of_many_units_leave_little_to_order(spark):
    """Of 40 000 units times 20 replicates only those in the bracket that holds a median are ordered."""
    rows = settle(spark.range(40_000).select(F.col("id").alias("unit"), (F.col("id") % 2).cast("int").alias("arm"), F.xxhash64("id").cast("double").alias("y")))
    cuts = E.bracket_cuts(rows)
    for arm, edges in cuts.items():
        y = np.array([r[0] for r in rows.where(F.col("arm") == arm).select("y").collect()])
        inner = np.histogram(y, [-np.inf, *edges, np.inf])[0][1:-1]
        assert len(edges) == E.BRACKETS - 1 and inner.max() < 0.005 * len(y)
    assert E.bootstrap_medians(rows, 20, "s").count() == 40


def test_permutations_read_their_round_values_from_a_table(spark):
    """No hash is made for a row, and values of fixed width are gathered without a sort."""
    df = spark.range(500).select("id", (F.col("id") * 3 % 97).cast("double").alias("x"))
    plan = P.shuffled_columns(df, ["x"], "id", "s")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "md5" not in physical and "SortAggregate" not in physical and "HashAggregate" in physical
