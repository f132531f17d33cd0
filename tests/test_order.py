"""Ordering primitives against brute force in pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import order as O
from sparkmetrica.operators import tables as X


def skewed(n=3000, seed=5):
    """A third of the rows in one group and a third on one value; NULL groups, NaN and NULL values."""
    r = np.random.default_rng(seed)
    g = np.where(r.random(n) < 0.4, "hot", r.choice(["a", "b", "c", "d"], n)).astype(object)
    g[r.random(n) < 0.05] = None
    v = np.where(r.random(n) < 0.35, 7.0, np.round(r.normal(0, 30, n), 1))
    v[r.random(n) < 0.04] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf, "id bigint, g string, v double").repartition(6)


def test_avg_rank(frame):
    pdf, df = frame
    got = O.avg_rank(df, "v").toPandas().set_index("id")["rank"].sort_index()
    np.testing.assert_array_equal(got, pdf["v"].rank())


def test_avg_rank_by_group_with_null_group(frame):
    pdf, df = frame
    got = O.avg_rank(df, "v", ["g"]).toPandas().set_index("id")["rank"].sort_index()
    np.testing.assert_array_equal(got, pdf.groupby("g", dropna=False)["v"].rank())


def test_quantiles(frame):
    pdf, df = frame
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = O.exact_quantiles(df, "v", probs, ["g"]).toPandas()
    assert len(got) == 6
    for _, row in got.iterrows():
        part = pdf["v"][pdf["g"].isna() if row["g"] is None else pdf["g"] == row["g"]].dropna()
        assert row["n"] == len(part)
        np.testing.assert_allclose([row[O.quantile_name(p)] for p in probs], part.quantile(list(probs)), rtol=1e-12)


def test_positions_and_running(frame):
    pdf, df = frame
    aggs = {"total": ("sum", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))), "top": ("max", F.col("id")), "low": ("min", F.col("id"))}
    got = O.running(df, ["g"], [F.desc("id")], aggs).toPandas().sort_values("id", ascending=False)
    want = pdf.sort_values("id", ascending=False)
    groups = want.groupby("g", dropna=False)
    np.testing.assert_allclose(got["total"], want.assign(v=want["v"].fillna(0)).groupby("g", dropna=False)["v"].cumsum(), atol=1e-9)
    np.testing.assert_array_equal(got["top"], groups["id"].cummax())
    np.testing.assert_array_equal(got["low"], groups["id"].cummin())
    placed = O.positions(df, [F.asc("id")]).toPandas().sort_values("id")
    np.testing.assert_array_equal(placed["pos"], np.arange(1, len(pdf) + 1))
    assert (placed["pos_total"] == len(pdf)).all()


def test_join_back_spreads_hot_keys(frame):
    pdf, df = frame
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = O.join_back(df, stats, ["g"], "n").toPandas().sort_values("id")
    want = pdf.groupby("g", dropna=False)["id"].transform("max")
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got["m"], want)


def test_identical_hot_rows_stay_spread(spark):
    """100 000 equal rows among others: no task of the join gets more than its share, without help from AQE."""
    rows = spark.range(0, 200_000, 1, 10).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(-F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        joined = O.join_back(rows, stats, ["v"], "n")
        counts = [r["count"] for r in joined.where("v = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert joined.count() == 200_000 and joined.where("v = 7 AND n = 100000").count() == 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(counts) == 100_000 and max(counts) <= 20_000


def test_running_shuffles_its_rows_for_the_window_only(spark):
    rows = spark.range(0, 10_000, 1, 4).select("id", (F.col("id") % 3).alias("g"))
    out = O.running(rows, ["g"], [F.col("id")], {"n": ("sum", F.lit(1))})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_at") == 3, plan  # the rows once, one row per group and block twice


def test_same_answer_on_any_partitioning(frame):
    _, df = frame
    one = O.exact_quantiles(df.coalesce(1), "v", (0.3,), ["g"]).toPandas().sort_values("g")
    many = O.exact_quantiles(df.repartition(17), "v", (0.3,), ["g"]).toPandas().sort_values("g")
    pd.testing.assert_frame_equal(one.reset_index(drop=True), many.reset_index(drop=True))


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_windows_cut_into_blocks(frame, block):
    pdf, df = frame
    spec = {"lag3": ("lag", "id", 3), "mean4": ("moving_mean", "v", 4), "run": ("running", "id")}
    got = X.add_window(df, ["g"], [F.col("id")], spec, block_rows=block).toPandas().sort_values("id")
    groups = pdf.groupby("g", dropna=False)
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got["lag3"].astype(float), groups["id"].shift(3))
    np.testing.assert_array_equal(got["run"], groups["id"].cumsum())
    want = groups["v"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    np.testing.assert_allclose(got["mean4"].astype(float), want, atol=1e-9)


def test_empty_and_all_missing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert O.exact_quantiles(empty, "v", (0.5,), ["g"]).count() == 0
    missing = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    assert O.exact_quantiles(missing, "v", (0.5,)).first()["q50"] is None
    assert [r["rank"] for r in O.avg_rank(missing, "v").collect()] == [None, None]
