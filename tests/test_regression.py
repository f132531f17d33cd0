import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sparkmetrica.operators import iv as V
from sparkmetrica.operators import moments as M
from sparkmetrica.operators import regression as R
from tests.fixtures import hidden_factor, listings


@pytest.fixture(scope="module")
def homes(spark):
    return listings(spark).repartition(4).cache()


@pytest.fixture(scope="module")
def fit(homes):
    return R.ols(homes, "ln_price", ["ln_area", "dist"])


def spark_ml(df, x, weight=None):
    rows = VectorAssembler(inputCols=x, outputCol="f").transform(df)
    est = LinearRegression(labelCol="ln_price", featuresCol="f", solver="normal")
    model = (est.setWeightCol(weight) if weight else est).fit(rows)
    # Spark lists the intercept last
    return np.roll([*model.coefficients, model.intercept], 1), np.roll(model.summary.coefficientStandardErrors, 1), model.summary


def test_ols_agrees_with_spark_ml(homes, fit):
    beta, se, summary = spark_ml(homes, ["ln_area", "dist"])
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-9)
    np.testing.assert_allclose(fit.se, se, rtol=1e-9)
    got = fit.measures()
    assert got["r2"] == pytest.approx(summary.r2, rel=1e-10) and got["adj_r2"] == pytest.approx(summary.r2adj, rel=1e-10)
    assert fit.slopes == pytest.approx([0.8, -0.05], abs=0.05)


def test_wls_agrees_with_spark_ml(homes):
    rows = homes.withColumn("w", 1 / F.col("area"))
    beta, _, _ = spark_ml(rows, ["ln_area", "dist"], "w")
    np.testing.assert_allclose(R.wls(rows, "ln_price", ["ln_area", "dist"], "w").beta, beta, rtol=1e-8)


def test_residuals_are_orthogonal_and_leverage_adds_up(homes, fit):
    got = R.influence(fit, homes).agg(
        F.sum("residual"), F.sum(F.col("residual") * F.col("ln_area")), F.sum(F.col("residual") * F.col("dist")), F.sum("leverage")
    ).first()
    np.testing.assert_allclose(got[:3], 0, atol=1e-7)
    assert got[3] == pytest.approx(3.0, rel=1e-9)


def test_wide_path_gives_the_same_moments(homes, monkeypatch):
    names = ["ln_price", "ln_area", "dist", "gap"]
    narrow = M.moments(homes, names)
    monkeypatch.setattr(M, "WIDE", 1)
    wide = M.moments(homes, names)
    assert (narrow.n, narrow.n_total) == (wide.n, wide.n_total) == (5400, 6000)
    np.testing.assert_allclose(wide.mean, narrow.mean, rtol=1e-12)
    np.testing.assert_allclose(wide.s, narrow.s, rtol=1e-9)


def test_prices_in_millions_lose_no_digits(homes):
    """Raw sums of squares would: the offset is a million times the spread."""
    shifted = homes.withColumn("y", F.col("ln_price") + 1e6).withColumn("x", F.col("dist") + 1e6)
    near = R.ols(homes, "ln_price", ["dist"])
    far = R.ols(shifted, "y", ["x"])
    assert far.slopes[0] == pytest.approx(near.slopes[0], rel=1e-6)
    assert far.rss == pytest.approx(near.rss, rel=1e-6)


def test_constant_and_collinear_columns_are_left_out(homes):
    with pytest.warns(UserWarning, match="one, twice"):
        got = R.ols(homes, "ln_price", ["dist", "one", "twice", "ln_area"])
    assert got.dropped == ["one", "twice"] and got.x == ["dist", "ln_area"]


def test_missing_rows_are_counted(homes):
    got = R.ols(homes, "ln_price", ["ln_area", "gap"]).measures()
    assert (got["n"], got["n_dropped"]) == (5400, 600)


def test_nan_counts_as_missing(homes):
    rows = homes.withColumn("gap", F.coalesce("gap", F.lit(float("nan"))))
    assert R.ols(rows, "ln_price", ["gap"]).measures()["n_dropped"] == 600
    fit = R.ols(rows, "ln_price", ["gap"])
    assert np.isfinite(R.robust_cov(fit, rows, "HC3").se).all()
    assert R.bp_test(fit, rows)["lm"] >= 0


def test_heteroskedasticity_is_found(homes, fit):
    assert R.bp_test(fit, homes)["p"] < 1e-6 and R.white_test(fit, homes)["p"] < 1e-6
    se = {k: R.robust_cov(fit, homes, k).se for k in ("HC0", "HC1", "HC2", "HC3")}
    assert (se["HC0"] < se["HC1"]).all() and (se["HC0"] < se["HC2"]).all() and (se["HC2"] < se["HC3"]).all()


def test_singleton_clusters_are_hc(homes, fit):
    each = R.cluster_cov(fit, homes, "id", "CR0")
    np.testing.assert_allclose(each.se, R.robust_cov(fit, homes, "HC0").se, rtol=1e-9)


@pytest.mark.parametrize("kind", ["HC0", "HC1", "HC2", "HC3"])
def test_weighted_robust_errors_do_not_depend_on_the_scale_of_weights(homes, kind):
    rows = homes.withColumns({"w1": F.lit(1.0), "w9": F.lit(9.0), "wv": 1 / F.col("area"), "wv9": 9 / F.col("area")})
    x = ["ln_area", "dist"]
    plain = R.robust_cov(R.ols(rows, "ln_price", x), rows, kind).se
    se = {w: R.robust_cov(R.wls(rows, "ln_price", x, w), rows, kind).se for w in ("w1", "w9", "wv", "wv9")}
    np.testing.assert_allclose(se["w1"], plain, rtol=1e-9)
    np.testing.assert_allclose(se["w9"], plain, rtol=1e-9)
    np.testing.assert_allclose(se["wv9"], se["wv"], rtol=1e-9)


def test_weighted_robust_errors_by_hand(homes):
    """HC0 of weighted least squares is HC0 of the rows scaled by the root of the weight."""
    rows = homes.withColumn("w", 1 / F.col("area"))
    fit = R.robust_cov(R.wls(rows, "ln_price", ["ln_area"], "w"), rows, "HC0")
    data = rows.select("ln_price", "ln_area", "w").toPandas()
    root = np.sqrt(data["w"].to_numpy())
    design = np.column_stack([root, root * data["ln_area"]])
    y = root * data["ln_price"].to_numpy()
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    meat = (design * (y - design @ beta)[:, None]).T @ (design * (y - design @ beta)[:, None])
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-8)
    np.testing.assert_allclose(fit.se, np.sqrt(np.diag(bread @ meat @ bread)), rtol=1e-7)


def test_wald_of_all_slopes_is_the_overall_f(fit):
    got = R.wald(fit, [[0, 1, 0], [0, 0, 1]])
    assert got["f"] == pytest.approx(fit.measures()["f"], rel=1e-9)


def test_reset_sees_curvature(homes):
    curved = homes.withColumn("y", 3 + F.col("ln_price") + 0.001 * F.pow(F.col("area") - 60, F.lit(2.0)))
    assert R.reset_test(R.ols(curved, "y", ["area"]), curved)["p"] < 1e-6


def test_design_and_fixed_effects_agree(spark, homes):
    rows, names = R.design(homes, "ln_price", ["ln_area", "dist", ("dummy", "district", "d0")])
    assert names == ["ln_area", "dist", "district=d1", "district=d2", "district=d3"]
    dummies = R.ols(rows, "y", names)
    inside = R.within(homes, "district", "ln_price", ["ln_area", "dist"])
    np.testing.assert_allclose(inside.slopes, dummies.slopes[:2], rtol=1e-9)
    np.testing.assert_allclose(inside.se[1:], dummies.se[1:3], rtol=1e-9)
    assert inside.df_resid == dummies.df_resid
    assert dummies.slopes[2:] == pytest.approx([0.1, 0.2, 0.3], abs=0.05)


def test_groups_too_small_or_flat_say_so(spark, homes):
    rows = homes.withColumn("g", F.when(F.col("id") < 2, "tiny").when(F.col("id") < 300, "flat").otherwise("rest"))
    rows = rows.withColumn("x", F.when(F.col("g") == "flat", F.lit(1.0)).otherwise(F.col("dist")))
    got = R.ols_by(rows, ["g"], "ln_price", ["x"]).toPandas()
    why = got.groupby("g")["reason"].first().to_dict()
    assert why == {"tiny": "too few rows", "flat": "constant or collinear", "rest": None} and len(got) == 6
    assert got.loc[got["g"] != "rest", ["coef", "se", "r2"]].isna().all(axis=None)
    got = got[got["g"] == "rest"]
    whole = R.ols(rows.where("g = 'rest'"), "ln_price", ["x"])
    np.testing.assert_allclose(got.set_index("term")["coef"][["const", "x"]], whole.beta, rtol=1e-9)


def test_constant_weights_change_nothing(spark, homes):
    rows = homes.withColumn("w", F.lit(4.0))
    plain, same = R.ols(rows, "ln_price", ["ln_area", "dist"]), R.wls(rows, "ln_price", ["ln_area", "dist"], "w")
    for c in ("aic", "bic", "r2", "f"):
        assert same.measures()[c] == pytest.approx(plain.measures()[c], rel=1e-9)
    for f in (R.predict, R.influence):
        a, b = (f(fit, rows).orderBy("id").toPandas() for fit in (plain, same))
        for c in {"pred_lo", "pred_hi", "student", "student_ext", "cooks_d", "leverage"} & set(a):
            if c == "pred_lo" or c == "pred_hi":  # a new row of weight 4 has a quarter of the variance s2 of the weighted fit, which is four times as large
                np.testing.assert_allclose(a[c], b[c], rtol=1e-9)
            else:
                np.testing.assert_allclose(a[c], b[c], rtol=1e-7)


def test_absorbed_groups_are_counted_and_guarded(spark, homes):
    rows = homes.withColumn("dist", F.when(F.col("id") % 10 != 0, F.col("dist")))
    inside = R.within(rows, "district", "ln_price", ["ln_area", "dist"])
    table, names = R.design(rows, "ln_price", ["ln_area", "dist", ("dummy", "district", "d0")])
    dummies = R.ols(table, "y", names)
    assert inside.measures()["n_dropped"] == dummies.measures()["n_dropped"] > 0
    assert inside.measures()["aic"] == pytest.approx(dummies.measures()["aic"], rel=1e-9)
    with pytest.raises(ValueError):
        R.cluster_cov(inside, rows, "district")


def test_stepwise_ignores_noise(homes):
    rows = homes.withColumn("nothing", F.rand(3))
    fit, path = R.stepwise(rows, "ln_price", ["nothing", "dist", "ln_area"], "bic")
    assert sorted(fit.x) == ["dist", "ln_area"] and len(path) == 2
    back, _ = R.stepwise(rows, "ln_price", ["nothing", "dist", "ln_area"], "bic", "backward")
    assert sorted(back.x) == ["dist", "ln_area"]


def test_contributions_add_up_to_r2(spark, fit):
    got = R.factor_effects(fit, spark).agg(F.sum("contribution")).first()[0]
    assert got == pytest.approx(fit.r2, rel=1e-12)


def test_prediction_interval_covers(homes, fit):
    inside = (F.col("ln_price") >= F.col("pred_lo")) & (F.col("ln_price") <= F.col("pred_hi"))
    share = R.predict(fit, homes).agg(F.avg(inside.cast("double"))).first()[0]
    assert 0.93 < share < 0.98


def test_two_stage_least_squares_on_planted_truth(spark):
    rows = hidden_factor(spark).cache()
    model = V.iv_model(rows, "y", ["w"], ["x"], ["z1", "z2"])
    ols, fit = V.ols_counterpart(model), V.iv2sls(model)
    at = fit.x.index("x")
    # values of the survey's probe for this fixture
    assert ols.slopes[at] == pytest.approx(2.276, abs=0.05) and fit.slopes[at] == pytest.approx(2.0, abs=0.05)
    assert V.first_stage(model, spark).first()["f"] > 1000
    assert V.dwh_test(model)["p"] < 1e-10
    assert V.overid_test(model)["p"] > 0.01 and V.overid_test(model, rows)["p"] > 0.01
    robust = R.robust_cov(fit, rows, "HC1")
    np.testing.assert_allclose(robust.se, fit.se, rtol=0.1)
    assert np.isfinite(R.cluster_cov(fit, rows, "cluster").se).all()


def test_dwh_equals_a_regression_with_first_stage_residuals(spark):
    rows = hidden_factor(spark, 3000).cache()
    model = V.iv_model(rows, "y", ["w"], ["x"], ["z1", "z2"])
    stage = R.ols(rows, "x", ["w", "z1", "z2"])
    added = rows.withColumn("v", stage.residual())
    long = R.ols(added, "y", ["w", "x", "v"])
    t = long.beta[3] / long.se[3]
    assert V.dwh_test(model)["f"] == pytest.approx(t * t, rel=1e-7)


def test_weak_and_invalid_instruments_are_reported(spark):
    weak = V.iv_model(hidden_factor(spark, strength=(0.01, 0.005)), "y", ["w"], ["x"], ["z1", "z2"])
    assert V.first_stage(weak, spark).first()["f"] < 10
    invalid = hidden_factor(spark, invalid=0.3)
    model = V.iv_model(invalid, "y", ["w"], ["x"], ["z1", "z2"])
    assert V.overid_test(model)["p"] < 1e-10 and V.overid_test(model, invalid)["p"] < 1e-10


def test_exactly_identified_models_cannot_be_tested(spark):
    model = V.iv_model(hidden_factor(spark, 500), "y", [], ["x"], ["z1"])
    with pytest.raises(ValueError, match="exactly identified"):
        V.overid_test(model)
    with pytest.raises(ValueError, match="fewer"):
        V.iv_model(hidden_factor(spark, 500), "y", [], ["x", "w"], ["z1"])
