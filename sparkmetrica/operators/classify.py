"""Binary classification: split, features, Spark ML models, exact evaluation."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform, num, ratio
from sparkmetrica.operators import order as O
from sparkmetrica.operators.permute import shuffled_columns
from sparkmetrica.session import discard, settle


def split(df: DataFrame, key, share: float = 0.8, seed: str = "split", strata=None, name: str = "is_train") -> DataFrame:
    """Marks training rows by a hash of ``key``; rows that share a key stay together.

    With ``strata`` the share is exact (rounded) inside every stratum; ``key``
    must then be unique.
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    u = hash_uniform(keys, seed)
    if strata is None:
        return df.withColumn(name, u < F.lit(share))
    strata = [strata] if isinstance(strata, str) else list(strata)
    placed = O.positions(df.withColumn("_u", u), [F.col("_u"), *[F.col(k) for k in keys]], strata)
    return placed.withColumn(name, F.col("pos") <= F.round(F.col("pos_total") * F.lit(share))).drop("_u", "pos", "pos_total")


def fold_of(key, folds: int, seed: str) -> Column:
    return F.floor(hash_uniform(key, seed) * F.lit(folds)).cast("int")


def feature_stages(numeric, categorical=(), binned=(), bins: int = 5, scale: bool = True) -> Pipeline:
    """Median imputation, quantile bins, one-hot levels, scaling, one vector.

    Fit it on training rows only. Unseen or missing levels get a slot of their own;
    lump rare levels first if a column has very many.
    """
    numeric, categorical, binned = list(numeric), list(categorical), list(binned)
    stages, parts = [], []
    if numeric or binned:
        filled = [*numeric, *binned]
        stages.append(Imputer(strategy="median", inputCols=filled, outputCols=[f"{c}_filled" for c in filled]))
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="_numeric"))
        if scale:
            stages.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True))
        parts.append("_scaled" if scale else "_numeric")
    indexed = []
    for c in binned:
        stages.append(QuantileDiscretizer(inputCol=f"{c}_filled", outputCol=f"{c}_bin", numBuckets=bins, handleInvalid="keep"))
        indexed.append(f"{c}_bin")
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"))
        indexed += [f"{c}_index" for c in categorical]
    if indexed:
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in indexed], handleInvalid="keep"))
        parts += [f"{c}_hot" for c in indexed]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that give both classes the same total."""
    n, pos = df.agg(F.count(num(label)), F.sum(num(label))).first()
    return df.withColumn(name, F.when(num(label) == 1.0, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos)))))


def fit_logit(df: DataFrame, label: str = "label", features: str = "features", weight: str | None = None, **params):
    """Elastic-net logistic regression (``regParam``, ``elasticNetParam``...)."""
    est = LogisticRegression(labelCol=label, featuresCol=features, **{"maxIter": 200, "tol": 1e-8, **params})
    return (est.setWeightCol(weight) if weight else est).fit(df)


TASK_ROWS = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew into partitions of about ``TASK_ROWS`` rows if one has over twice as many; as it is otherwise.

    Tree learners hold the binned rows of a partition in memory and read them again for every level, many times the size of
    the compressed files that Spark cuts its partitions by.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    most, rows = sizes.agg(F.max("rows"), F.sum("rows")).first()
    return df.repartition(-(-rows // TASK_ROWS)) if (most or 0) > 2 * TASK_ROWS else df


def fit_tree(df: DataFrame, label: str = "label", features: str = "features", **params):
    return DecisionTreeClassifier(labelCol=label, featuresCol=features, **params).fit(spread(df))


def fit_forest(df: DataFrame, label: str = "label", features: str = "features", **params):
    return RandomForestClassifier(labelCol=label, featuresCol=features, **{"seed": 7, **params}).fit(spread(df))


def fit_gbt(df: DataFrame, label: str = "label", features: str = "features", **params):
    """Boosted trees. Long boosting runs cut their lineage every ten rounds."""
    return GBTClassifier(labelCol=label, featuresCol=features, **{"seed": 7, **params}).fit(spread(df))


def fit_svm(df: DataFrame, label: str = "label", features: str = "features", **params):
    return LinearSVC(labelCol=label, featuresCol=features, **params).fit(df)


def fit_nb(df: DataFrame, label: str = "label", features: str = "features", **params):
    return NaiveBayes(labelCol=label, featuresCol=features, **params).fit(df)


def fit_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """The majority class and the accuracy of always answering it."""
    share = df.agg(F.count(num(label)).alias("n"), F.avg(num(label)).alias("positive_rate"))
    return share.withColumns(
        {
            "majority": F.when(F.col("positive_rate") >= 0.5, 1).otherwise(0),
            "accuracy": F.greatest(F.col("positive_rate"), 1 - F.col("positive_rate")),
        }
    )


def scores(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Model output as one number per row: P(label = 1), or the margin of an SVM."""
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn(name, vector_to_array(source)[1])


def tune(estimator: Estimator, grid, df: DataFrame, key, folds: int = 3, seed: str = "folds", label: str = "label") -> CrossValidatorModel:
    """Grid search with folds by a hash of ``key``: the same folds on every run."""
    rows = df.withColumn("fold", fold_of(key, folds, seed))
    judge = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=2)
    return search.fit(rows)


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates at a threshold; a row is called positive if score >= threshold."""
    y, called = num(label), num(score) >= F.lit(float(threshold))
    out = df.agg(
        F.count_if((y == 1) & called).alias("tp"), F.count_if((y == 0) & called).alias("fp"),
        F.count_if((y == 1) & ~called).alias("fn"), F.count_if((y == 0) & ~called).alias("tn"),
    )
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and MCC from ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": ratio(tn, tn + fp),
            "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )


def _by_score(df: DataFrame, label: str, score: str, descending: bool = False) -> DataFrame:
    rows = df.where(num(label).isNotNull())
    return O.ordered_counts(rows, score, sums={"pos": (num(label) == 1).cast("bigint")}, descending=descending)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. NULL if a class is absent."""
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    out = _by_score(df, label, score).agg(
        F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.sum(rank * F.col("pos")).alias("_r")
    )
    p = F.col("positives").cast("double")
    return out.select("positives", "negatives", ratio(F.col("_r") - p * (p + 1) / 2, p * F.col("negatives")).alias("auc"))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Confusion counts at every distinct score used as the threshold."""
    curve = _by_score(df, label, score, descending=True)
    called, tp = F.col("n_before") + F.col("n"), F.col("pos_before") + F.col("pos")
    return curve.select(
        F.col("value").alias("threshold"), tp.alias("tp"), (called - tp).alias("fp"),
        (F.col("pos_total") - tp).alias("fn"),
        (F.col("n_total") - F.col("pos_total") - called + tp).alias("tn"),
        F.col("pos").alias("new_tp"),
    )


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score: ``threshold, fpr, tpr``. The origin is implied."""
    t = score_table(df, label, score)
    return t.select(
        "threshold", ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"), ratio("tp", F.col("tp") + F.col("fn")).alias("tpr")
    )


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    t = score_table(df, label, score)
    return t.select(
        "threshold", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall")
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision summed over the steps of recall."""
    t = score_table(df, label, score)
    step = ratio("new_tp", F.col("tp") + F.col("fn")) * ratio("tp", F.col("tp") + F.col("fp"))
    return t.agg(F.sum(step).alias("average_precision"))


def proper_scores(df: DataFrame, label: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Log loss (probabilities clipped to ``eps``) and Brier score."""
    y, q = num(label), num(p)
    clipped = F.least(F.greatest(q, F.lit(eps)), F.lit(1 - eps))
    loss = -(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))
    # least and greatest skip NULL, so a missing probability is masked here
    loss = F.when(q.isNotNull(), loss)
    return df.agg(F.count(loss).alias("n"), F.avg(loss).alias("log_loss"), F.avg((q - y) * (q - y)).alias("brier"))


def calibration(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Mean predicted and observed rate in equal-width bins of the prediction."""
    q = num(p)
    place = F.least(F.floor(q * F.lit(bins)), F.lit(bins - 1)).cast("int")
    rows = df.where(q.isNotNull() & num(label).isNotNull())
    return rows.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(q).alias("predicted"), F.avg(num(label)).alias("observed")
    )


def best_threshold(df: DataFrame, label: str, score: str, metric: str = "f1", cost_fp: float = 1.0, cost_fn: float = 1.0) -> DataFrame:
    """Threshold with the best ``f1``, ``accuracy``, ``mcc``, ``youden`` or least ``cost``.

    Ties go to the higher threshold.
    """
    t = with_rates(score_table(df, label, score)).withColumns(
        {
            "youden": F.col("recall") + F.col("specificity") - 1,
            "cost": -(F.lit(cost_fp) * F.col("fp") + F.lit(cost_fn) * F.col("fn")),
        }
    )
    best = t.where(F.col(metric).isNotNull()).agg(
        F.max(F.struct(F.col(metric), F.col("threshold"), F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).alias("b")
    )
    sign = -1.0 if metric == "cost" else 1.0
    return best.select("b.threshold", (F.col(f"b.{metric}") * sign).alias(metric), "b.tp", "b.fp", "b.fn", "b.tn")


def lift_table(df: DataFrame, label: str, score: str, key, n: int = 10) -> DataFrame:
    """Gain and lift by score group, best scores first. ``key`` breaks ties of the score."""
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    rows = df.select(num(label).alias("y"), num(score).alias("s"), *keys).dropna(subset=["y", "s"])
    placed = O.positions(rows, [F.col("s").desc(), *[F.col(k) for k in keys]])
    # sizes of ntile: the first (total mod n) groups hold one row more
    total, at = F.col("pos_total"), F.col("pos") - 1
    size, larger = F.floor(total / F.lit(n)), F.pmod(total, F.lit(n))
    edge = larger * (size + 1)
    group = F.when(at < edge, F.floor(at / (size + 1))).otherwise(larger + F.floor(F.try_divide(at - edge, size)))
    table = settle(
        placed.groupBy((group + 1).cast("int").alias("group")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.min("s").alias("min_score")
        )
    )
    sums = table.agg(F.sum("positives"), F.sum("n")).first()
    base = sums[0] / sums[1] if sums[1] else None
    found = O.running(table, [], [F.col("group")], {"_p": ("sum", F.col("positives"))})  # n rows
    return found.select(
        "group", "n", "positives", "min_score", ratio("positives", "n").alias("rate"),
        ratio(ratio("positives", "n"), F.lit(base).cast("double")).alias("lift"), ratio("_p", F.lit(sums[0])).alias("gain"),
    )


def importance(model, df: DataFrame, columns, key, label: str = "label", seed: str = "shuffle") -> DataFrame:
    """Loss of AUC when one column is permuted, for each column: ``feature, auc, auc_permuted, importance``.

    ``model`` has ``transform``, or is a column expression of the score. The rows are put in order once, whatever the number of columns;
    each permutation is computed from a row's place. All scores are ordered in one pass. ``key`` is unique.
    """
    columns = list(columns)
    rows = settle(shuffled_columns(df, columns, key, seed, keep=df.columns))
    found = []
    for i, c in enumerate([None, *columns]):
        one = rows.select(*[F.col(f"{x}_new" if x == c else x).alias(x) for x in df.columns])
        one = one.withColumn("score", model) if isinstance(model, Column) else scores(model, one)
        found.append(one.select(F.lit(i).alias("which"), num(label).alias("y"), "score"))
    long = O.union_all(found)
    counts = O.ordered_counts(long.where("y IS NOT NULL"), "score", ["which"], {"pos": (F.col("y") == 1).cast("bigint")})
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    pos, neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos"))
    areas = counts.groupBy("which").agg(ratio(F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))
    got = {r["which"]: r["auc"] for r in areas.collect()}  # one row a column
    discard(rows)
    before = got.get(0)
    lost = lambda after: None if before is None or after is None else before - after
    table = [(c, before, got.get(i), lost(got.get(i))) for i, c in enumerate(columns, 1)]
    return df.sparkSession.createDataFrame(table, "feature string, auc double, auc_permuted double, importance double")
