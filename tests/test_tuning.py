"""Fold sums, penalty paths and Newton fits against plain numpy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import newton as N
from sparkmetrica.operators import penalty as P
from sparkmetrica.operators import tuning as T
from sparkmetrica.operators.moments import moments
from sparkmetrica.plans import QUERIES
from sparkmetrica.session import settle

STRENGTHS = [0.01, 0.1, 1.0]


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, -3]
    x[:, 2] += 0.05 * x[:, 0]
    y = 2 + x @ [1.0, 0.3, -4.0] + rng.normal(size=n)
    gaps = rng.random((n, 3)) < [0.0, 0.2, 0.05]
    label = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + 0.2 * (x[:, 1] - 5))))).astype(float)
    return x, y, gaps, label


@pytest.fixture(scope="module")
def data():
    return made()


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, gaps, label = data
    table = [(i, float(y[i]), float(label[i]), *[None if gaps[i, j] else float(x[i, j]) for j in range(3)], "ab"[i % 2] if i % 7 else None) for i in range(len(y))]
    return spark.createDataFrame(table, "id long, y double, label double, a double, b double, c double, kind string").repartition(4).cache()


@pytest.fixture(scope="module")
def fold(rows):
    return np.array([r[0] for r in rows.orderBy("id").select(T.fold_of("id", 4, "folds")).collect()])


def filled(data, train):
    x, _, gaps, _ = data
    means = [x[train & ~gaps[:, j], j].mean() for j in range(3)]
    return np.where(gaps, means, x)


def plain_net(x, y, strength, mix, steps=4000):
    """Proximal gradient in standardised units."""
    mx, sx, my, sy = x.mean(0), x.std(0), y.mean(), y.std()
    z, t = (x - mx) / sx, (y - my) / sy
    l1, l2, b = strength * mix / sy, strength * (1 - mix) / sy, np.zeros(x.shape[1])
    top = np.linalg.eigvalsh(z.T @ z / len(y)).max() + l2
    for _ in range(steps):
        v = b + (z.T @ (t - z @ b) / len(y) - l2 * b) / top
        b = np.sign(v) * np.maximum(np.abs(v) - l1 / top, 0)
    slopes = b * sy / sx
    return my - mx @ slopes, slopes


@pytest.mark.parametrize("mix", [0.0, 0.5, 1.0])
def test_tuning_equals_refitting_every_fold(rows, data, fold, mix):
    got = {(r.strength, r.fold): r for r in T.tune_net(rows, "y", ["a", "b", "c"], "id", STRENGTHS, mix, 4).collect()}
    y = data[1]
    for f in range(4):
        train = fold != f
        x = filled(data, train)
        for s in STRENGTHS:
            b0, b = plain_net(x[train], y[train], s, mix)
            r = got[s, f]
            assert (r.n_train, r.n_test) == (train.sum(), (~train).sum())
            assert r.mse == pytest.approx(np.mean((y - b0 - x @ b)[~train] ** 2), rel=1e-7)


def test_an_outlier_changes_nothing_in_the_fold_that_holds_it(rows, fold):
    """Filling, scaling and the fit of the fold come from the others: only its own error moves."""
    one = int(np.flatnonzero(fold == 2)[0])
    spoilt = rows.withColumn("b", F.when(F.col("id") == one, 1e6).otherwise(F.col("b"))).withColumn("y", F.when(F.col("id") == one, -1e5).otherwise(F.col("y")))
    before, after = (T.fold_parts(d, "y", ["a", "b", "c"], "id", 4, "folds") for d in (rows, spoilt))
    for f in range(4):
        a, b = (T.others(p, f) for p in (before, after))
        same = np.allclose(a.mean, b.mean) and np.allclose(a.s, b.s)
        assert same == (f == 2)
    errors = [{r.fold: r.mse for r in T.tune_net(d, "y", ["a", "b", "c"], "id", [0.1], 0.0, 4).collect()} for d in (rows, spoilt)]
    assert errors[1][2] > 1e6 and all(errors[0][f] != errors[1][f] for f in (0, 1, 3))
    whole = [T.tune_logit(d, "label", ["a", "b"], "id", [0.1], folds=4)[1][2] for d in (rows, spoilt)]
    assert whole[0].without == 2 and np.allclose(whole[0].centre, whole[1].centre) and np.allclose(whole[0].beta, whole[1].beta)


def test_infinities_and_nans_are_gaps(spark, rows):
    odd = rows.withColumn("b", F.when(F.col("b").isNull(), F.when(F.col("id") % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(F.col("b")))
    one, two = (sorted(tuple(r) for r in T.tune_net(d, "y", ["a", "b"], "id", [0.1]).collect()) for d in (rows, odd))
    assert np.allclose(one, two, rtol=1e-10)


def test_rows_without_outcome_and_empty_folds(spark, rows):
    few = rows.where("id < 3").withColumn("y", F.when(F.col("id") > 0, F.col("y")))
    got = T.tune_net(few, "y", ["a"], "id", [0.1], folds=5).collect()
    assert all(r.n_train + r.n_test == 2 for r in got)
    assert T.tune_net(rows.where("false"), "y", ["a"], "id", [0.1]).count() == 0


def test_choice_takes_the_strongest_within_one_error(spark):
    rows = [(0.1, f, 1, 1, v) for f, v in enumerate([1.0, 1.2, 0.8])] + [(1.0, f, 1, 1, v) for f, v in enumerate([1.05, 1.1, 0.9])] + [(9.0, f, 1, 1, 5.0) for f in range(3)]
    got = {r.strength: r for r in T.chosen(spark.createDataFrame(rows, T.SCORES)).collect()}
    assert got[0.1].best and not got[0.1].simplest and got[1.0].simplest and not got[9.0].best
    assert got[0.1].se == pytest.approx(0.2 / 3**0.5)


@pytest.mark.parametrize("mix", [0.1, 0.5, 1.0])
def test_path_meets_the_conditions_of_the_optimum(rows, data, mix):
    full = rows.na.fill(0.0, ["a", "b", "c"])
    x, y = np.where(data[2], 0.0, data[0]), data[1]
    got = P.net_path(full, "y", ["a", "b", "c"], mix=mix, steps=12).collect()
    assert max(r.kkt for r in got) < 1e-11 and max(abs(r.gap) for r in got) < 1e-11
    strengths = sorted({r.strength for r in got}, reverse=True)
    assert next(r.active for r in got if r.strength == strengths[0]) == 0
    assert next(r.active for r in got if r.strength == strengths[-1]) == 3
    for s in strengths[::4]:
        fit = {r.term: r.coef for r in got if r.strength == s}
        b0, b = plain_net(x, y, s, mix)
        assert fit["const"] == pytest.approx(b0, abs=1e-7) and [fit[c] for c in "abc"] == pytest.approx(b.tolist(), abs=1e-7)


def test_constant_and_collinear_columns(rows):
    wide = rows.withColumns({"twice": 2 * F.col("a"), "one": F.lit(3.0)})
    for mix in (0.0, 0.5):
        fit = {r.term: r for r in P.net_path(wide, "y", ["a", "twice", "one"], [0.2], mix).collect()}
        assert fit["one"].coef == 0 and all(r.kkt < 1e-11 for r in fit.values())
    flat = P.net_path(wide, "one", ["a"], [0.2], 0.5).collect()
    assert {r.term: r.coef for r in flat} == {"const": 3.0, "a": 0.0}


def test_weights_are_copies(rows):
    doubled = rows.union(rows.where("id < 100"))
    weighed = rows.withColumn("w", F.when(F.col("id") < 100, 2.0).otherwise(1.0))
    one = P.net_path(doubled, "y", ["a", "c"], [0.1], 0.5).collect()
    two = P.net_path(weighed, "y", ["a", "c"], [0.1], 0.5, weight="w").collect()
    assert [r.coef for r in one] == pytest.approx([r.coef for r in two], abs=1e-9)


def test_violation_and_gap_show_a_wrong_answer(rows):
    m = moments(rows, ["y", "a"])
    corr = m.block(["a"], ["a"]) / m.block(["a"], ["a"])
    cross = m.block(["a"], ["y"])[:, 0] / np.sqrt(m.block(["a"], ["a"])[0, 0] * m.block(["y"], ["y"])[0, 0])
    right, _ = P.descend(corr, cross, 0.05, 0.1, np.zeros(1), 1e-13, 100)
    wrong = right * 1.01
    assert P.violations(cross - corr @ right, right, 0.05, 0.1).max() < 1e-12 < 1e-4 < P.violations(cross - corr @ wrong, wrong, 0.05, 0.1).max()
    assert P.duality_gap(corr, cross, right, 0.05, 0.1) < 1e-12 < 1e-6 < P.duality_gap(corr, cross, wrong, 0.05, 0.1)


def newton_plain(z, y, penalty, weight):
    b, ridge = np.zeros(z.shape[1]), np.r_[0.0, np.full(z.shape[1] - 1, penalty)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + np.diag(ridge), z.T @ (weight * (y - p)) / weight.sum() - ridge * b)
    return b


def test_all_folds_and_penalties_fitted_together(rows, data, fold):
    scores, models = T.tune_logit(rows, "label", ["a", "b", "c"], "id", [0.0, 0.1], ["kind"], folds=4)
    got = {(r.strength, r.fold): r for r in scores.collect()}
    assert len(got) == 8 and all(r.converged and r.slope < 1e-10 for r in got.values())
    label, n = data[3], len(data[3])
    kinds = np.array([[i % 7 != 0 and "ab"[i % 2] == k for k in "ab"] for i in range(n)], float)
    for m in models:
        train = fold != m.without
        x = np.hstack([filled(data, train), kinds])
        z = np.hstack([np.ones((n, 1)), (x - x[train].mean(0)) / x[train].std(0)])
        b = newton_plain(z[train], label[train], m.penalty, np.ones(train.sum()))
        assert m.beta == pytest.approx(b, abs=1e-8)
        p = 1 / (1 + np.exp(-z @ b))[~train]
        t, r = label[~train], got[m.penalty, m.without]
        assert r.log_loss == pytest.approx(-np.mean(t * np.log(p) + (1 - t) * np.log(1 - p)), abs=1e-9)
        area = np.mean([(a > b) + (a == b) / 2 for a in p[t == 1] for b in p[t == 0]])
        assert r.auc == pytest.approx(area, abs=1e-9)


def test_levels_missing_from_training_have_no_effect(spark):
    """A level that is only in the held-out fold is constant in training."""
    folds = [r[0] for r in spark.range(60).select(T.fold_of("id", 3, "folds")).orderBy("id").collect()]
    table = [(i, float(i % 2 or i % 3 == 0), float(i % 5), "rare" if folds[i] == 1 else "usual") for i in range(60)]
    df = spark.createDataFrame(table, "id long, label double, x double, kind string")
    _, models = T.tune_logit(df, "label", ["x"], "id", [0.1], ["kind"])
    assert [m.beta[2:].tolist() for m in models if m.without == 1] == [[0.0, 0.0]]


def test_weighted_fit_and_coefficients_in_units_of_the_columns(spark, rows, data):
    label, x = data[3], data[0][:, 0]
    ready = settle(N.batches_of(rows.withColumn("w", 1 + F.col("label")), ["a"], "label", None, "w"))
    m = N.fit(ready, [N.Logit(np.zeros(1), np.array([0.3]), np.array([2.5]))])[0]
    b = newton_plain(np.stack([np.ones(len(x)), x], 1), label, 0.0, 1 + label)
    assert m.converged and m.coefficients() == pytest.approx(b, abs=1e-8)


def test_separable_classes_end_unconverged(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, label double")
    ready = settle(N.batches_of(df, ["x"], "label", None, None))
    free, held = N.fit(ready, [N.Logit(np.zeros(1), np.array([5.5]), np.ones(1), p) for p in (0.0, 0.1)])
    assert not free.converged and held.converged


def test_the_documents_fits_converge(spark):
    assert spark.createDataFrame(QUERIES["logit_documents"](spark, "/root/testdata/sf0.01").collect()).first()["converged"]
    assert all(r.converged and r.mean_auc > 0.6 for r in QUERIES["tune_logit"](spark, "/root/testdata/sf0.01").collect())
