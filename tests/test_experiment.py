import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import experiment as E
from sparkmetrica.operators import hypothesis as H
from tests.fixtures import experiment


@pytest.fixture(scope="module")
def units(spark):
    return experiment(spark).repartition(4).cache()


def test_known_lift_is_found_and_cuped_narrows_it(units):
    plain, adjusted = H.ttest(units, "y", "arm").first(), E.cuped(units, "arm", "y", "pre").first()
    # three standard errors: a 95 percent interval misses the truth in one data set of twenty
    assert abs(plain["diff"] - 0.2) < 3 * plain["se"] and abs(adjusted["diff"] - 0.2) < 3 * adjusted["se"]
    assert adjusted["se"] < 0.4 * plain["se"] and adjusted["raw_se"] == pytest.approx(plain["se"], rel=1e-9)
    assert adjusted["theta"] == pytest.approx(1.0, abs=0.05)


def test_cuped_equals_the_test_on_the_adjusted_metric(units):
    got = E.cuped(units, "arm", "y", "pre").first()
    mean = units.agg(F.avg("pre")).first()[0]
    adjusted = units.withColumn("z", F.col("y") - got["theta"] * (F.col("pre") - mean))
    want = H.ttest(adjusted, "z", "arm").first()
    for c in ("diff", "se", "df", "t"):
        assert got[c] == pytest.approx(want[c], rel=1e-8)


def test_sample_ratio(spark, units):
    assert E.srm(units, "arm").first()["p"] > 0.001
    assert E.srm(experiment(spark, share=0.55), "arm").first()["p"] < 1e-6


def test_silent_units_count_as_zero(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    events = spark.createDataFrame([(1, 2.0), (1, 3.0), (9, 1.0)], "u int, v double")
    got = {r["u"]: (r["s"], r["n"]) for r in E.unit_metrics(events, "u", {"s": F.sum("v"), "n": F.count("v")}, units).collect()}
    assert got == {1: (5.0, 2), 2: (0.0, 0), 3: (0.0, 0)}


def test_hand_worked_welch(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 8.0), (1, None), (1, float("nan"))], "arm int, y double")
    got = H.ttest(rows, "y", "arm").first()
    se2 = 1 / 3 + 8 / 2
    assert (got["n0"], got["n1"]) == (3, 2) and got["diff"] == 4.0
    assert got["se"] == pytest.approx(math.sqrt(se2)) and got["df"] == pytest.approx(se2**2 / ((1 / 3) ** 2 / 2 + 4.0**2))


def test_empty_arm_and_zero_variance_give_null(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 1.0)], "arm int, y double")
    got = H.ttest(rows, "y", "arm").first()
    assert got["n1"] == 0 and got["t"] is None and got["p"] is None
    flat = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "arm int, y double")
    assert H.ttest(flat, "y", "arm").first()["t"] is None
    assert H.anova(flat, "arm", "y").first()["f"] is None


def test_bootstrap_agrees_with_the_formula(units):
    plain = H.ttest(units, "y", "arm").first()
    got = E.bootstrap(units, "id", "arm", "y", 200).first()
    assert got["se"] == pytest.approx(plain["se"], rel=0.2) and got["mean_diff"] == pytest.approx(plain["diff"], abs=0.01)
    assert got["ci_lo"] < plain["diff"] < got["ci_hi"]


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = E.poisson_weight(F.col("u"))
    got = spark.range(20000).select(E.hash_uniform("id", "w").alias("u")).agg(F.avg(w), F.var_samp(w)).first()
    assert got[0] == pytest.approx(1, abs=0.03) and got[1] == pytest.approx(1, abs=0.05)


def test_permutation_test_rejects_only_with_an_effect(spark, units):
    assert E.permutation_test(units.where("id < 1500"), "id", "arm", "y", 60).first()["p"] < 0.05
    same = experiment(spark, 1500, lift=0.0)
    assert E.permutation_test(same, "id", "arm", "noise", 60).first()["p"] > 0.05


def test_aa_rate_lies_in_its_band(units):
    got = E.aa_check(units, "id", "y", 100).first()
    assert got["tests"] == 100 and got["band_lo"] <= got["rate"] <= got["band_hi"]


def test_report_agrees_with_single_tests(units):
    rows = {(r["segment"], r["level"], r["metric"]): r for r in E.ab_report(units, "arm", ["y", "converted"], ["segment"]).collect()}
    assert len(rows) == 2 * (1 + units.select("segment").distinct().count())
    hot = H.ttest(units.where("segment = 'hot'"), "y", "arm").first()
    assert rows["segment", "hot", "y"]["t"] == pytest.approx(hot["t"], rel=1e-9)
    assert rows["all", None, "converted"]["p"] == pytest.approx(H.ttest(units, "converted", "arm").first()["p"], rel=1e-9)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.03]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "i int, p double")
    got = {m: [r["p_adj"] for r in E.adjust_p(rows, "p", m, "i").orderBy("i").collect()] for m in ("bh", "holm", "bonferroni")}
    assert got["bh"] == pytest.approx([0.03, 0.048, 0.045, 0.03, 0.8, 0.045])
    assert got["holm"] == pytest.approx([0.05, 0.12, 0.12, 0.03, 0.8, 0.12])
    assert got["bonferroni"] == pytest.approx([0.06, 0.24, 0.18, 0.03, 1.0, 0.18])


def test_sample_size_has_the_wanted_power(units):
    need = E.power_table(units, "y", (0.02,)).first()["n_per_arm"]
    assert E.achieved_power(units, "y", 0.02, need) == pytest.approx(0.8, abs=0.005)


def test_rank_tests_agree_with_brute_force(spark):
    r = np.random.default_rng(3)
    a, b = np.round(r.normal(0, 1, 60), 1), np.round(r.normal(0.4, 1, 50), 1)
    rows = spark.createDataFrame([(0, float(v)) for v in a] + [(1, float(v)) for v in b], "arm int, y double")
    u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    got = H.mannwhitney(rows, "arm", "y").first()
    assert got["u"] == pytest.approx(u) and got["prob_superior"] == pytest.approx(u / 3000)
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in [*a, *b])
    assert H.ks_2samp(rows, "arm", "y").first()["d"] == pytest.approx(d)


def test_all_tied_values(spark):
    rows = spark.createDataFrame([(i % 2, 1.0) for i in range(10)], "arm int, y double")
    got = H.mannwhitney(rows, "arm", "y").first()
    assert got["u"] == 12.5 and got["sd"] == 0.0 and got["z"] is None


def test_chi2_by_hand(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 40}
    rows = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    got = H.chi2_test(rows, "a", "b").first()
    assert got["chi2"] == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60)) and got["df"] == 1
