import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkmetrica.operators import classify as C
from tests.fixtures import scored


@pytest.fixture(scope="module")
def rows(spark):
    return VectorAssembler(inputCols=["f1", "f2"], outputCol="features").transform(scored(spark)).repartition(4).cache()


def test_auc_symmetry_and_ties(rows):
    auc = C.auc(rows, "label", "score").first()["auc"]
    flipped = C.auc(rows.withColumn("score", 1 - F.col("score")), "label", "score").first()["auc"]
    assert auc > 0.8 and flipped == pytest.approx(1 - auc, abs=1e-12)
    assert C.auc(rows.withColumn("score", F.lit(0.3)), "label", "score").first()["auc"] == 0.5
    assert C.auc(rows.where("label = 1"), "label", "score").first()["auc"] is None
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(rows)
    assert auc == pytest.approx(spark_auc, abs=1e-9)


def test_curve_ends_and_area(rows):
    curve = C.roc_curve(rows, "label", "score").orderBy(F.desc("threshold")).collect()
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    area, x, y = 0.0, 0.0, 0.0
    for p in curve:
        area, x, y = area + (p["fpr"] - x) * (p["tpr"] + y) / 2, p["fpr"], p["tpr"]
    assert area == pytest.approx(C.auc(rows, "label", "score").first()["auc"], abs=1e-9)


def test_best_threshold_is_the_best_of_all(rows):
    best = C.best_threshold(rows, "label", "score", "f1").first()
    for t in (0.2, 0.35, 0.5, 0.7):
        assert C.confusion(rows, "label", "score", t).first()["f1"] <= best["f1"] + 1e-12
    assert C.confusion(rows, "label", "score", best["threshold"]).first()["f1"] == pytest.approx(best["f1"])


def test_split_is_stable_and_stratified_exactly(rows):
    one = {r["id"] for r in C.split(rows, "id").where("is_train").select("id").collect()}
    two = {r["id"] for r in C.split(rows.repartition(11), "id").where("is_train").select("id").collect()}
    assert one == two and 0.77 < len(one) / rows.count() < 0.83
    shares = C.split(rows, "id", 0.25, strata="label").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t"))
    for r in shares.collect():
        assert abs(r["t"] - 0.25 * r["n"]) <= 0.5


def test_logit_solves_its_score_equations(rows):
    model = C.fit_logit(rows)
    assert model.coefficients[0] == pytest.approx(1.5, abs=0.15) and abs(model.coefficients[1]) < 0.1
    gap = F.col("label") - F.col("score")
    got = C.scores(model, rows).agg(F.avg(gap), F.avg(gap * F.col("f1")), F.avg(gap * F.col("f2"))).first()
    assert max(abs(v) for v in got) < 1e-5


@pytest.mark.parametrize("fit", [C.fit_tree, C.fit_forest, C.fit_gbt, C.fit_svm])
def test_other_models_learn(rows, fit):
    train = C.split(rows, "id")
    model = fit(train.where("is_train"))
    assert C.auc(C.scores(model, train.where("NOT is_train")), "label", "score").first()["auc"] > 0.8


def test_importance_finds_the_only_feature(spark):
    rows = scored(spark, 2000)
    assembler = VectorAssembler(inputCols=["f1", "f2"], outputCol="features")
    model = C.fit_logit(assembler.transform(rows))

    class Scorer:
        def transform(self, df):
            return model.transform(assembler.transform(df))

    got = {r["feature"]: r["importance"] for r in C.importance(Scorer(), rows.select("id", "label", "f1", "f2"), ["f1", "f2"], "id").collect()}
    assert got["f1"] > 0.25 and abs(got["f2"]) < 0.02


def test_features_are_learnt_on_training_rows_only(spark):
    rows = spark.createDataFrame(
        [(1.0, "a", True), (2.0, "b", True), (None, "a", True), (3.0, None, True), (100.0, "new", False)], "x double, c string, train boolean"
    )
    model = C.feature_stages(["x"], ["c"]).fit(rows.where("train"))
    got = [r["features"].toArray() for r in model.transform(rows).collect()]
    assert sum(v[0] for v in got[:4]) == pytest.approx(0)  # centred on the training rows, gap filled with their median
    assert got[4][1:].tolist() == [0.0, 0.0, 1.0][: len(got[4]) - 1]


def test_missing_scores_are_left_out(spark):
    rows = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, None), (None, 0.5)], "label double, p double")
    got = C.proper_scores(rows, "label", "p").first()
    assert got["n"] == 2 and got["brier"] == pytest.approx(0.01)


def test_binned_features(spark):
    rows = spark.range(100).select((F.col("id") / 10).alias("x"), F.when(F.col("id") % 9 != 0, F.col("id").cast("double")).alias("y"))
    model = C.feature_stages(["x"], binned=["y"], bins=4, scale=False).fit(rows)
    got = [r["features"].toArray() for r in model.transform(rows).orderBy("x").collect()]
    assert all(v[1:].sum() == 1 for v in got) and got[0][0] == 0.0 and got[99][0] == 9.9
    assert got[1][1:].argmax() == 0 and got[98][1:].argmax() == 3


def test_tuning_uses_the_same_folds_on_any_partitioning(rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder

    est = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(est.regParam, [0.001, 1.0]).build()
    one, two = C.tune(est, grid, rows, "id"), C.tune(est, grid, rows.repartition(3), "id")
    assert one.avgMetrics == pytest.approx(two.avgMetrics, abs=1e-6) and min(one.avgMetrics) > 0.8


def test_trees_are_grown_on_partitions_of_bounded_size(spark, monkeypatch):
    rows = spark.range(4000).coalesce(1).select((F.col("id") % 40).cast("double").alias("x"), ((F.col("id") % 40 > 17) | (F.col("id") % 9 == 0)).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).select("label", "features")
    before = C.fit_gbt(rows, maxIter=2, maxDepth=1).toDebugString
    assert C.spread(rows) is rows
    monkeypatch.setattr(C, "TASK_ROWS", 500)
    sizes = [r["n"] for r in C.spread(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 1000
    cut = lambda text: [word for word in text.split() if word.endswith(")") and word[0].isdigit()]  # noqa: E731  weights and thresholds
    assert cut(C.fit_gbt(rows, maxIter=2, maxDepth=1).toDebugString) == cut(before)
    assert C.spread(rows.where("false")).count() == 0
