import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkmetrica.operators import classify as C
from sparkmetrica.operators import margin as M
from sparkmetrica.operators import newton as N
from sparkmetrica.operators import trees as R


@pytest.fixture(scope="module")
def table():
    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(400, 3)), 1)
    y = ((x[:, 0] + 0.5 * x[:, 1] + g.normal(size=400) * 0.7) > 0.4).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, table):
    x, y = table
    plain = spark.createDataFrame([(float(a), float(b), float(c), float(v)) for (a, b, c), v in zip(x, y)], "a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(plain).repartition(3).cache()


def walked(table, x, tree):
    """Rows of every node, by walking each row down."""
    at = {r["node"]: r for r in table if r["tree"] == tree}
    members = {n: [] for n in at}
    leaf = []
    for i, v in enumerate(x):
        node = 0
        while True:
            members[node].append(i)
            r = at[node]
            if r["left"] is None:
                leaf.append(r["prediction"])
                break
            node = r["left"] if v[r["feature"]] <= r["threshold"] else r["right"]
    return members, np.array(leaf)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_audit_is_what_a_walk_down_the_trees_counts(spark, rows, table, kind):
    x, y = table
    model = {
        "tree": lambda: C.fit_tree(rows, maxDepth=3), "forest": lambda: C.fit_forest(rows, numTrees=4, bootstrap=False, featureSubsetStrategy="1"),
        "boosted": lambda: C.fit_gbt(rows, maxIter=4, maxDepth=2),
    }[kind]()
    nodes = R.nodes(spark, model)
    got = {(r["tree"], r["node"]): r for r in R.audit(model, rows).collect()}
    assert len(got) == len(nodes)
    total = np.zeros(len(y))
    for tree, weight in enumerate(R.tree_weights(model)):
        members, leaf = walked(nodes, x, tree)
        target = y if kind != "boosted" else 2 * y - 1 if tree == 0 else 4 * (2 * y - 1) / (1 + np.exp(2 * (2 * y - 1) * total))
        spread = (lambda t: 2 * t.mean() * (1 - t.mean())) if kind != "boosted" else np.var
        for node, own in members.items():
            r = got[tree, node]
            assert r["n"] == len(own) == r["stated_n"]
            assert r["mean"] == pytest.approx(target[own].mean(), abs=1e-9) and r["impurity"] == pytest.approx(spread(target[own]), abs=1e-9)
            if r["feature"] is not None:
                at = next(n for n in nodes if n["tree"] == tree and n["node"] == node)
                below = sum(len(members[c]) * spread(target[members[c]]) for c in (at["left"], at["right"]))
                assert r["gain"] == pytest.approx(spread(target[own]) - below / len(own), abs=1e-9)
        total += weight * leaf
    proof = R.certificate(R.audit(model, rows)).collect()
    assert max(r["gap"] for r in proof) < 1e-9 and {r["n"] for r in proof} == {400}


def test_audit_shows_rows_that_a_model_was_not_fitted_on(spark, rows):
    model = C.fit_tree(rows, maxDepth=3)
    other = rows.withColumn("label", F.when(F.col("a") > 1, 1 - F.col("label")).otherwise(F.col("label")))
    assert R.certificate(R.audit(model, other)).first()["gap"] > 0.01
    nothing = R.audit(model, rows.where("a > 1000"))
    assert {(r["n"], r["mean"], r["impurity"]) for r in nothing.collect()} == {(0, None, None)}
    assert R.certificate(nothing).first()["gap"] == 1.0
    gaps = rows.union(rows.limit(5).withColumn("label", F.lit(None).cast("double")))
    assert R.certificate(R.audit(model, gaps)).first()["gap"] < 1e-9  # rows without label have no part


def batches(spark, x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    data = [(*[None if np.isnan(v) else float(v) for v in r], None if np.isnan(t) else float(t), float(u)) for r, t, u in zip(x, y, w)]
    names = [f"x{i}" for i in range(len(x[0]))]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names) + ", label double, w double").repartition(3)
    return N.batches_of(df, names, "label", None, "w").cache()


def criterion(x, y, beta, penalty, width=0.0):
    short = 1 - (2 * y - 1) * (beta[0] + x @ beta[1:])
    loss = np.maximum(short, 0) if not width else np.where(short > width, short - width / 2, np.maximum(short, 0) ** 2 / (2 * width))
    return loss.mean() + penalty / 2 * beta[1:] @ beta[1:]


@pytest.mark.parametrize("width", [None, 1.0, 0.1])
def test_no_other_coefficients_are_better_than_the_bound(spark, table, width):
    x, y = table
    model = M.fit(batches(spark, x, y), np.zeros(3), np.ones(3), 0.05, width=width, tol=1e-5)
    assert model.converged and 0 <= model.primal - model.dual <= 1e-5 * model.primal
    assert model.primal == pytest.approx(criterion(x, y, model.beta, 0.05, width or 0.0), abs=1e-12)
    g = np.random.default_rng(1)
    for size in (1e-4, 1e-2, 0.1, 1.0):
        for _ in range(200):
            assert criterion(x, y, model.beta + g.normal(size=4) * size, 0.05, width or 0.0) >= model.dual - 1e-12


def test_weights_are_repeated_rows_and_odd_rows_have_no_part(spark, table):
    x, y = table
    twice = np.where(np.arange(400) % 5 == 0, 2.0, 1.0)
    one = M.fit(batches(spark, x, y, twice), np.zeros(3), np.ones(3), 0.1, width=0.5, tol=1e-11)
    extra = np.concatenate([x, x[::5], x[:7]]), np.concatenate([y, y[::5], np.full(7, np.nan)])
    two = M.fit(batches(spark, *extra), np.zeros(3), np.ones(3), 0.1, width=0.5, tol=1e-11)
    assert one.rows == two.rows == 480 and one.beta == pytest.approx(two.beta, abs=1e-6)
    centre, scale = x.mean(axis=0), x.std(axis=0) * np.array([1, 1, 0.0])
    gap = x.copy()
    gap[3, 0] = np.nan
    filled = x.copy()
    filled[3, 0] = centre[0]
    three, four = (M.fit(batches(spark, v, y), centre, scale, 0.1, width=0.5, tol=1e-11) for v in (gap, filled))
    assert three.beta == pytest.approx(four.beta, abs=1e-9) and three.coefficients()[3] == 0.0


def test_one_class_no_rows_and_ties(spark, table):
    x, y = table
    alone = M.fit(batches(spark, x, np.ones(400)), np.zeros(3), np.ones(3), 0.1)
    assert alone.primal == pytest.approx(0, abs=1e-6) and alone.dual == pytest.approx(0, abs=1e-9)
    same = M.fit(batches(spark, np.zeros((30, 1)), np.array([1.0] * 20 + [0.0] * 10)), [0.0], [1.0], 0.1, tol=1e-6)
    assert same.converged and same.primal == pytest.approx(2 / 3, abs=1e-5)
    with pytest.raises(ValueError):
        M.fit(batches(spark, x, y).where("y > 5"), np.zeros(3), np.ones(3), 0.1)
    with pytest.raises(ValueError):
        M.fit(batches(spark, x, y), np.zeros(3), np.ones(3), 0.0)
