"""Binary classification queries.

Evaluation runs on all of ``lineitem`` with a tied score; models are fitted on
``lineitem``, where simple ones have closed forms, and on the labelled documents.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkmetrica.operators import classify as C
from sparkmetrica.plans.registry import query, sql_uniform
from sparkmetrica.session import settle
from sparkmetrica.sources.tables import load

SCORED_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'R')::int::double AS label, round(l_quantity / 51 + l_discount / 5, 2) / 1.2 AS score FROM lineitem"""


def scored(spark, folder):
    """Return flag against a score with many ties."""
    score = F.round(F.col("l_quantity") / 51 + F.col("l_discount") / 5, 2) / F.lit(1.2)
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").cast("double").alias("label"), score.alias("score")
    )


@query(
    "split_by_hash",
    f"SELECT {sql_uniform('o_custkey', 'split')} < 0.7 AS is_train, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
)
def split_by_hash(spark, folder):
    """All orders of a customer land on the same side."""
    marked = C.split(load(spark, folder, "orders"), "o_custkey", 0.7)
    return marked.groupBy("is_train").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "split_stratified",
    f"""
    WITH r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_uniform('o_orderkey', 'split')}, o_orderkey) AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, i <= round(n * 0.8::double) AS is_train, count(*) AS n, sum(o_totalprice) AS total FROM r GROUP BY 1, 2
    """,
    "total",
    digits=2,
)
def split_stratified(spark, folder):
    marked = C.split(load(spark, folder, "orders"), "o_orderkey", 0.8, strata="o_orderstatus")
    return marked.groupBy("o_orderstatus", "is_train").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


_TRAIN = sql_uniform("l_orderkey", "split") + " < 0.7"


@query(
    "feature_stages",
    f"""
    WITH t AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_samp(l_extendedprice) AS se FROM lineitem WHERE {_TRAIN})
    SELECT l_linestatus, count(*) AS n, avg((l_quantity - mq) / sq) AS quantity, avg((l_extendedprice - me) / se) AS price,
      (l_linestatus = 'O')::int::double + (l_linestatus = 'F')::int AS hot FROM lineitem, t WHERE NOT {_TRAIN} GROUP BY 1
    """,
    "quantity price hot",
)
def feature_stages(spark, folder):
    """Scaling learnt on the training rows, applied to the test rows."""
    rows = C.split(load(spark, folder, "lineitem"), "l_orderkey", 0.7)
    stages = C.feature_stages(["l_quantity", "l_extendedprice"], ["l_linestatus"]).fit(rows.where("is_train"))
    x = stages.transform(rows.where("NOT is_train")).withColumn("x", vector_to_array("features"))
    hot = F.aggregate(F.slice("x", 3, F.size("x") - 2), F.lit(0.0), lambda s, v: s + v)
    return x.groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.avg(F.col("x")[0]).alias("quantity"), F.avg(F.col("x")[1]).alias("price"), F.avg(hot).alias("hot")
    )


def flagged(spark, folder):
    """Return flag R and one binary feature: fitted probabilities are group shares."""
    rows = load(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_linestatus") == "O").cast("double").alias("open")
    )
    rows = rows.withColumn("closed", 1 - F.col("open"))
    return VectorAssembler(inputCols=["open", "closed"], outputCol="both").transform(
        VectorAssembler(inputCols=["open"], outputCol="features").transform(rows)
    )


SHARE_SQL = "SELECT (l_linestatus = 'O')::int::double AS open, avg((l_returnflag = 'R')::int) AS score FROM lineitem GROUP BY 1"


def _group_scores(model, df):
    return C.scores(model, df).groupBy("open").agg(F.avg("score").alias("score"))


@query("logit_closed_form", SHARE_SQL, "score")
def logit_closed_form(spark, folder):
    rows = flagged(spark, folder)
    return _group_scores(C.fit_logit(rows), rows)


@query(
    "logit_weighted",
    """
    WITH g AS (SELECT l_linestatus = 'O' AS open, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1),
    t AS (SELECT sum(a) AS a, sum(b) AS b FROM g)
    SELECT open::int::double AS open, (g.a / t.a::double) / (g.a / t.a::double + g.b / t.b::double) AS score FROM g, t
    """,
    "score",
)
def logit_weighted(spark, folder):
    """Class weights: each class counts for half."""
    rows = C.class_weights(flagged(spark, folder), "label")
    return _group_scores(C.fit_logit(rows, weight="weight"), rows)


@query(
    "tree_closed_form",
    "SELECT (l_linestatus = 'O')::int::double AS open, avg((l_quantity > CASE l_linestatus WHEN 'O' THEN 30 ELSE 20 END)::int) AS score FROM lineitem GROUP BY 1",
    "score",
)
def tree_closed_form(spark, folder):
    """The label is rarer among open lines, so one split is right and leaves hold group shares."""
    rows = load(spark, folder, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("double"))
    rows = rows.select("open", (F.col("l_quantity") > 20 + 10 * F.col("open")).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["open"], outputCol="features").transform(rows)
    return _group_scores(C.fit_tree(rows, maxDepth=2), rows)


@query(
    "naive_bayes_closed_form",
    """
    WITH g AS (SELECT (l_returnflag = 'R')::int AS y, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS c FROM lineitem GROUP BY 1),
    t AS (SELECT y, (n + 1) / (sum(n) OVER () + 2)::double AS prior, (o + 1) / (n + 2)::double AS po, (c + 1) / (n + 2)::double AS pc FROM g)
    SELECT 1.0::double AS open, sum(prior * po) FILTER (y = 1) / sum(prior * po) AS score FROM t
    UNION ALL SELECT 0.0::double, sum(prior * pc) FILTER (y = 1) / sum(prior * pc) FROM t
    """,
    "score",
)
def naive_bayes_closed_form(spark, folder):
    rows = flagged(spark, folder)
    return _group_scores(C.fit_nb(rows, features="both", smoothing=1.0), rows)


def documents(spark, folder):
    """Labelled documents with features of the whole text; copies share a group key.

    The texts are read once: only the features feed the fits that follow.
    """
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    n = F.greatest(F.length("text"), F.lit(1))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", "")) / n
    words = F.size(F.split("text", r"\s+"))
    rows = docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("double").alias("label"), letters.alias("letter_share"),
        (n / words).alias("word_length"), F.ln(n.cast("double")).alias("ln_chars"),
        (F.length(F.regexp_replace("text", r"[^0-9]+", "")) / n).alias("digit_share"), F.md5("text").alias("copy_key"),
    )
    return settle(C.split(rows, "copy_key", 0.7))


NUMERIC = ["letter_share", "word_length", "ln_chars", "digit_share"]


def _featured(spark, folder):
    rows = documents(spark, folder)
    stages = C.feature_stages(NUMERIC, ["lang"]).fit(rows.where("is_train"))
    # fits are iterative: the features are written once and read in every step
    ready = settle(stages.transform(rows).select("doc_id", "label", "is_train", "features"))
    return ready.where("is_train"), ready.where("NOT is_train")


def _evaluated(name, fit):
    def run(spark, folder):
        train, test = _featured(spark, folder)
        return C.auc(C.scores(fit(train), test), "label", "score").withColumn("model", F.lit(name))

    query(f"{name}_documents")(run)


_evaluated("tree", lambda d: C.fit_tree(d, maxDepth=4))
_evaluated("forest", lambda d: C.fit_forest(d, numTrees=20))
_evaluated("boosted_trees", lambda d: C.fit_gbt(d, maxIter=10, maxDepth=3))
_evaluated("svm", lambda d: C.fit_svm(d, maxIter=50))


@query(
    "baseline_majority",
    """SELECT count(*) AS n, avg(quality) AS positive_rate, (avg(quality) >= 0.5)::int AS majority, greatest(avg(quality), 1 - avg(quality)) AS accuracy FROM labels""",
    "positive_rate accuracy",
)
def baseline_majority(spark, folder):
    return C.fit_baseline(load(spark, folder, "labels"), "quality")


RATES_SQL = """(tp + tn) / (tp + fp + fn + tn)::double AS accuracy, tp / (tp + fp)::double AS precision, tp / (tp + fn)::double AS recall,
    2 * tp / (2 * tp + fp + fn)::double AS f1, tn / (tn + fp)::double AS specificity,
    (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc"""


@query(
    "confusion",
    f"""SELECT *, {RATES_SQL} FROM (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM ({SCORED_SQL}))""",
    "accuracy precision recall f1 specificity mcc",
)
def confusion(spark, folder):
    return C.confusion(scored(spark, folder), "label", "score")


@query(
    "auc_exact",
    f"""
    WITH s AS ({SCORED_SQL}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM s),
    k AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, sum(r) FILTER (label = 1) AS s FROM r)
    SELECT positives, negatives, (s - positives * (positives + 1) / 2.0::double) / (positives::double * negatives) AS auc FROM k
    """,
    "auc",
    digits=9,
)
def auc_exact(spark, folder):
    return C.auc(scored(spark, folder), "label", "score")


CURVE_SQL = f"""
    WITH g AS (SELECT score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM ({SCORED_SQL}) GROUP BY 1),
    t AS (SELECT score AS threshold, p, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS pos, sum(n - p) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC))
"""


@query("roc_curve", CURVE_SQL + "SELECT threshold, fp / neg::double AS fpr, tp / pos::double AS tpr FROM t", "threshold fpr tpr")
def roc_curve(spark, folder):
    return C.roc_curve(scored(spark, folder), "label", "score")


@query("pr_curve", CURVE_SQL + "SELECT threshold, tp / (tp + fp)::double AS precision, tp / pos::double AS recall FROM t", "threshold precision recall")
def pr_curve(spark, folder):
    return C.pr_curve(scored(spark, folder), "label", "score")


@query("average_precision", CURVE_SQL + "SELECT sum(p / pos::double * (tp / (tp + fp)::double)) AS average_precision FROM t", "average_precision", 9)
def average_precision(spark, folder):
    return C.average_precision(scored(spark, folder), "label", "score")


@query(
    "proper_scores",
    f"""SELECT count(*) AS n, avg(-(label * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))) AS log_loss,
    avg((score - label) ** 2) AS brier FROM ({SCORED_SQL})""",
    "log_loss brier",
)
def proper_scores(spark, folder):
    return C.proper_scores(scored(spark, folder), "label", "score")


@query(
    "calibration",
    f"SELECT least(floor(score * 10), 9)::int AS bin, count(*) AS n, avg(score) AS predicted, avg(label) AS observed FROM ({SCORED_SQL}) GROUP BY 1",
    "predicted observed",
)
def calibration(spark, folder):
    return C.calibration(scored(spark, folder), "label", "score")


@query(
    "best_threshold_f1",
    CURVE_SQL + """, f AS (SELECT threshold, 2 * tp / (2 * tp + fp + pos - tp)::double AS f1, tp::bigint AS tp, fp::bigint AS fp, (pos - tp)::bigint AS fn, (neg - fp)::bigint AS tn FROM t)
    SELECT * FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1""",
    "threshold f1",
)
def best_threshold_f1(spark, folder):
    return C.best_threshold(scored(spark, folder), "label", "score", "f1")


@query(
    "best_threshold_cost",
    CURVE_SQL + """, f AS (SELECT threshold, (fp + 2.5 * (pos - tp))::double AS cost, tp::bigint AS tp, fp::bigint AS fp, (pos - tp)::bigint AS fn, (neg - fp)::bigint AS tn FROM t)
    SELECT * FROM f ORDER BY cost, threshold DESC LIMIT 1""",
    "threshold cost",
)
def best_threshold_cost(spark, folder):
    return C.best_threshold(scored(spark, folder), "label", "score", "cost", 1.0, 2.5)


@query(
    "lift_table",
    f"""
    WITH s AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey)::int AS g FROM ({SCORED_SQL})),
    t AS (SELECT g, count(*) AS n, sum(label) AS positives, min(score) AS min_score FROM s GROUP BY g)
    SELECT g AS "group", n, positives, min_score, positives / n AS rate, (positives / n) / (sum(positives) OVER () / sum(n) OVER ()) AS lift,
      sum(positives) OVER (ORDER BY g) / sum(positives) OVER () AS gain FROM t
    """,
    "positives min_score rate lift gain",
)
def lift_table(spark, folder):
    return C.lift_table(scored(spark, folder), "label", "score", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("permutation_importance")
def permutation_importance(spark, folder):
    """Loss of AUC on the test documents when a feature is shuffled."""
    rows = documents(spark, folder)
    assembler = VectorAssembler(inputCols=NUMERIC, outputCol="features")
    train = settle(assembler.transform(rows.where("is_train")).select("label", "features"))
    model = C.fit_forest(train, numTrees=20)

    class Scorer:
        """Assembles the features again, so that a shuffled column counts."""

        def transform(self, df):
            return model.transform(assembler.transform(df))

    return C.importance(Scorer(), rows.where("NOT is_train").select("doc_id", "label", *NUMERIC), NUMERIC, "doc_id")


SHUFFLED = ["l_quantity", "l_discount", "l_tax"]
LINEAR_SQL = "{q} / 50 + 3 * {d} - 2 * {t}"


def _pass_sql(x: str, c: str) -> str:
    """One pass of the four rounds of a permutation's network, as nested queries over ``l`` and ``r``."""
    rows = f"SELECT *, {x} % a AS l0, {x} // a AS r0 FROM ({{rows}})"
    h = lambda turn, half: f"('0x' || substr(md5('shuffle:' || {c} || ':{turn}:' || {half}), 1, 8))::bigint"
    rows = f"SELECT *, (l0 + {h(0, 'r0')}) % a AS l1 FROM ({rows})"
    rows = f"SELECT *, (r0 + {h(1, 'l1')}) % b AS r1 FROM ({rows})"
    rows = f"SELECT *, (l1 + {h(2, 'r1')}) % a AS l2 FROM ({rows})"
    return f"SELECT *, (r1 + {h(3, 'l2')}) % b AS r2 FROM ({rows})"


def importance_sql() -> str:
    key = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || (epoch_us(l_shipdate) // 1000000)"
    walk = lambda rows, x: f"SELECT p, c, n, a, b, r2 * a + l2 AS x FROM ({_pass_sql(x, 'c').format(rows=rows)})"
    auc = """(sum(rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))"""
    return f"""
    WITH RECURSIVE placed AS (SELECT *, (l_returnflag = 'R')::int::double AS label, row_number() OVER (ORDER BY {sql_uniform(key, 'shuffle')}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS p,
      count(*) OVER () AS n FROM lineitem),
    sized AS (SELECT *, ceil(sqrt(n))::bigint AS a, ceil(n / ceil(sqrt(n)))::bigint AS b FROM placed),
    start AS (SELECT p, c, n, a, b FROM sized, (SELECT unnest({SHUFFLED}) AS c)),
    walks AS ({walk('SELECT * FROM start', 'p')} UNION ALL {walk('SELECT * FROM walks WHERE x >= n', 'x')}),
    new AS (SELECT x AS place, c, CASE c WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS v FROM walks JOIN sized USING (p) WHERE x < walks.n),
    scored AS (SELECT '' AS feature, label, {LINEAR_SQL.format(q='l_quantity', d='l_discount', t='l_tax')} AS score FROM placed
      UNION ALL SELECT c, label, CASE c WHEN 'l_quantity' THEN {LINEAR_SQL.format(q='v', d='l_discount', t='l_tax')} WHEN 'l_discount' THEN {LINEAR_SQL.format(q='l_quantity', d='v', t='l_tax')}
        ELSE {LINEAR_SQL.format(q='l_quantity', d='l_discount', t='v')} END FROM new JOIN placed ON place = p),
    ranked AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY feature, round(score, 6)) - 1) / 2.0::double AS rank FROM scored),
    areas AS (SELECT feature, {auc} AS auc FROM ranked GROUP BY feature)
    SELECT s.feature, o.auc, s.auc AS auc_permuted, o.auc - s.auc AS importance FROM areas s, areas o WHERE o.feature = '' AND s.feature <> ''
    """


@query("permutation_importance_linear", importance_sql(), "auc auc_permuted importance", 9)
def permutation_importance_linear(spark, folder):
    """Loss of AUC of a fixed linear score over all of lineitem when one of its columns is permuted."""
    shipped = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("shipped")
    rows = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shipped, (F.col("l_returnflag") == "R").cast("double").alias("label"), *SHUFFLED
    )
    score = F.round(F.col("l_quantity") / 50 + 3 * F.col("l_discount") - 2 * F.col("l_tax"), 6)
    return C.importance(score, rows, SHUFFLED, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "shipped"])
