"""Margins, trees and boosted trees that carry their proof, recomputed in SQL from the rows they were fitted on."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkmetrica.operators import classify as C
from sparkmetrica.operators import margin as M
from sparkmetrica.operators import newton as N
from sparkmetrica.operators import trees as R
from sparkmetrica.plans.classifiers import NUMERIC, documents
from sparkmetrica.plans.registry import query, sql_uniform
from sparkmetrica.session import discard, settle
from sparkmetrica.sources.tables import load

#: The labelled documents on the training side, with features of their whole texts.
TRAIN_SQL = f"""SELECT quality::double AS label, length(regexp_replace(text, '\\P{{L}}+', '', 'g')) / n AS letter_share, n / len(regexp_split_to_array(text, '[\\t\\n\\v\\f\\r ]+')) AS word_length,
    ln(n) AS ln_chars, length(regexp_replace(text, '[^0-9]+', '', 'g')) / n AS digit_share
    FROM (SELECT *, greatest(length(text), 1)::double AS n FROM documents) JOIN labels USING (doc_id) WHERE {sql_uniform('md5(text)', 'split')} < 0.7"""


def prepared(spark, folder):
    """Training documents as batches, and the centres and scales of their features."""
    rows = documents(spark, folder).where("is_train")
    facts = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(NUMERIC) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, spreads = (N.np.array([facts[f"{n}{i}"] for i in range(len(NUMERIC))], float) for n in "ms")
    return settle(N.batches_of(rows, NUMERIC, "label", None, None)), means, spreads


def descent_sql(penalty: float, width: float, rate: float, steps: int) -> str:
    """Coefficients by plain gradient descent on the rounded hinge."""
    k = range(1, len(NUMERIC) + 1)
    score = "b0" + "".join(f" + b{i} * z{i}" for i in k)
    slope = {i: f"avg(y * a{f' * z{i}' if i else ''})" for i in (0, *k)}
    facts = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMERIC, 1))
    return f"""
    WITH RECURSIVE r AS MATERIALIZED ({TRAIN_SQL}), q AS (SELECT {facts} FROM r),
    z AS MATERIALIZED (SELECT 2 * label - 1 AS y, {', '.join(f'({c} - m{i}) / s{i} AS z{i}' for i, c in enumerate(NUMERIC, 1))} FROM r, q),
    w AS (SELECT 0 AS step, {', '.join(f'0.0::double AS b{i}' for i in (0, *k))}
      UNION ALL SELECT any_value(step) + 1, any_value(b0) + {rate} * {slope[0]}, {', '.join(f'any_value(b{i}) + {rate} * ({slope[i]} - {penalty} * any_value(b{i}))' for i in k)}
      FROM (SELECT *, least(greatest((1 - y * ({score})) / {width}, 0), 1) AS a FROM w, z WHERE step < {steps}) HAVING count(*) > 0),
    e AS (SELECT * FROM w WHERE step = {steps})
    SELECT term, coef FROM (SELECT unnest(['const', {', '.join(repr(c) for c in NUMERIC)}]) AS term, unnest([{', '.join(f'b{i}' for i in (0, *k))}]) AS coef FROM e)
    """


@query("svm_rounded_documents", descent_sql(0.1, 1.0, 0.4, 1500), "coef", 6)
def svm_rounded_documents(spark, folder):
    """Standardised coefficients of a machine with the hinge rounded over one margin."""
    ready, means, spreads = prepared(spark, folder)
    model = M.fit(ready, means, spreads, 0.1, width=1.0, tol=1e-11)
    discard(ready)
    return spark.createDataFrame(list(zip(["const", *NUMERIC], model.beta.tolist())), "term string, coef double")


@query("svm_gap_documents", f"SELECT count(*) AS n, sum(label)::bigint AS positives, true AS within, true AS bound_below FROM ({TRAIN_SQL})")
def svm_gap_documents(spark, folder):
    """The plain hinge on the labelled documents: primal and dual within 1e-4 of each other."""
    ready, means, spreads = prepared(spark, folder)
    model = M.fit(ready, means, spreads, 0.1, tol=1e-4)
    facts = settle(ready.agg(F.count("y").alias("n"), F.sum("y").cast("long").alias("positives")))
    discard(ready)
    return facts.withColumns({"within": F.lit(model.primal - model.dual <= 1e-4 * model.primal), "bound_below": F.lit(model.dual <= model.primal + 1e-12)})


@query(
    "svm_closed_form",
    """
    WITH c AS (SELECT (l_linestatus = 'O')::int AS x, 2 * (l_returnflag = 'R')::int - 1 AS y, count(*) / (sum(count(*)) OVER ())::double AS p FROM lineitem GROUP BY 1, 2),
    -- for a given slope an intercept at some cell's margin is best; along such a line the optimum is a kink or a zero of the slope of some active cells
    lines AS (SELECT s, x0 FROM (SELECT unnest([-1, 1]) AS s), (SELECT unnest([0, 1]) AS x0)),
    actives AS (SELECT s, x0, up, down, coalesce(sum(p * y * (x - x0)) FILTER (CASE y WHEN 1 THEN up ELSE down END), 0) / 0.1::double AS w
      FROM lines, (SELECT unnest([true, false]) AS up), (SELECT unnest([true, false]) AS down), c GROUP BY ALL),
    points AS (SELECT w, s - w * x0 AS b FROM actives UNION SELECT w, s - w * x0 FROM lines, (SELECT unnest([-2.0::double, 0.0, 2.0]) AS w)),
    values AS (SELECT w, b, any_value(0.05::double * w * w) + sum(p * greatest(0, 1 - y * (b + w * x))) AS v FROM points, c GROUP BY w, b)
    SELECT (SELECT count(*) FROM lineitem) AS n, min(v) AS primal, min(v) AS dual FROM values
    """.replace("values", "found"),
    "primal dual",
    5,
)
def svm_closed_form(spark, folder):
    """Return flag R by line status over all of lineitem: four kinds of rows, so the optimum can be listed."""
    rows = load(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_linestatus") == "O").cast("double").alias("open"))
    kinds = settle(rows.groupBy("label", "open").agg(F.count(F.lit(1)).cast("double").alias("rows")))  # equal rows are one row of their weight
    model = M.fit(N.batches_of(kinds, ["open"], "label", None, "rows"), [0.0], [1.0], 0.1, tol=1e-7)
    discard(kinds)
    return spark.createDataFrame([(model.rows, model.primal, model.dual)], "n long, primal double, dual double")


GROWN = ["l_quantity", "l_discount", "l_tax"]
LARGE = "CASE WHEN l_quantity <= 24 THEN l_discount >= 0.08 ELSE l_tax >= 0.02 END OR l_linenumber = 7"


def sized(spark, folder):
    """A label that depends on three columns together."""
    rows = load(spark, folder, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in GROWN], F.expr(LARGE).cast("int").cast("double").alias("label"))
    return settle(VectorAssembler(inputCols=GROWN, outputCol="features").transform(rows).select("label", "features"))


def split_sql(rows: str, name: str) -> str:
    """Common tables that find the best split of each ``node`` of ``rows`` for the target ``t``: ``{name}(node, n, s, q, f, threshold, nl, sl, ql)``."""
    return f"""
    {name}l AS (SELECT node, f, v, count(*) AS n, sum(t) AS s, sum(t * t) AS q FROM (SELECT node, t, unnest([0, 1, 2]) AS f, unnest([{', '.join(f'{c}::double' for c in GROWN)}]) AS v FROM {rows}) GROUP BY ALL),
    {name}c AS (SELECT node, f, v, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(q) OVER up AS ql, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q
      FROM {name}l WINDOW w AS (PARTITION BY node, f), up AS (PARTITION BY node, f ORDER BY v)),
    {name} AS (SELECT node, n, s, q, f, (v + next) / 2 AS threshold, nl, sl, ql FROM {name}c JOIN cuts USING (f, v) WHERE nl < n
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY sl ** 2 / nl + (s - sl) ** 2 / (n - nl) DESC, f, v) = 1)"""


BASE_SQL = f"""
    r AS (SELECT *, ({LARGE})::int::double AS label FROM lineitem),
    cuts AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS next FROM (SELECT DISTINCT unnest([0, 1, 2]) AS f, unnest([{', '.join(f'{c}::double' for c in GROWN)}]) AS v FROM lineitem))"""
_VALUE = "CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END"
TREE_SQL = f"""
    WITH {BASE_SQL}, r1 AS (SELECT *, 1 AS node, label AS t FROM r), {split_sql('r1', 'b1')},
    r2 AS (SELECT r1.* REPLACE (2 + ({_VALUE} > threshold)::int AS node) FROM r1, b1), {split_sql('r2', 'b2')},
    a AS (SELECT 0 AS depth, * FROM b1 UNION ALL SELECT 1, * FROM b2)
    SELECT depth, f AS feature, threshold, n::bigint AS n, s / n AS mean, 2 * s / n * (1 - s / n) AS impurity, 2 * (sl ** 2 / nl + (s - sl) ** 2 / (n - nl) - s ** 2 / n) / n AS gain FROM a
"""


@query("tree_splits", TREE_SQL, "threshold mean impurity gain", 9)
def tree_splits(spark, folder):
    """Splits of a tree of depth two over all of lineitem, with counts, shares, impurities and gains recounted from the rows."""
    rows = sized(spark, folder)
    model = C.fit_tree(rows, maxDepth=2, maxBins=64)
    return R.audit(model, rows).where("feature IS NOT NULL").select("depth", "feature", "threshold", "n", "mean", "impurity", "gain")


def _boost_sql(rounds: int) -> str:
    """Stumps one after the other: each takes what those before leave."""
    parts, answers, rows = [BASE_SQL, "g0 AS (SELECT *, 1 AS node, 0.0::double AS sum, 2 * label - 1 AS t FROM r)"], [], "g0"
    for i in range(rounds):
        parts.append(split_sql(rows, f"s{i}").strip())
        weight = 1.0 if i == 0 else 0.1
        total = f"g.sum + {weight} * CASE WHEN {_VALUE} > threshold THEN (s - sl) / (n - nl) ELSE sl / nl END"
        parts.append(f"h{i} AS (SELECT g.* REPLACE ({total} AS sum) FROM {rows} AS g, s{i})")
        parts.append(f"g{i + 1} AS (SELECT * REPLACE (4 * (2 * label - 1) / (1 + exp(2 * (2 * label - 1) * sum)) AS t) FROM h{i})")
        answers.append(f"SELECT {i}::int AS tree, 0 AS node, f AS feature, threshold, n::bigint AS n, s / n AS mean, q / n - (s / n) ** 2 AS impurity FROM s{i}")
        answers.append(f"SELECT {i}::int, 1, NULL, NULL, nl::bigint, sl / nl, ql / nl - (sl / nl) ** 2 FROM s{i}")
        answers.append(f"SELECT {i}::int, 2, NULL, NULL, (n - nl)::bigint, (s - sl) / (n - nl), (q - ql) / (n - nl) - ((s - sl) / (n - nl)) ** 2 FROM s{i}")
        rows = f"g{i + 1}"
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(answers)


@query("boosted_stumps", _boost_sql(3), "threshold mean impurity", 8)
def boosted_stumps(spark, folder):
    """Three boosted stumps over all of lineitem: the targets of each are what the ones before leave, recounted from the rows."""
    rows = sized(spark, folder)
    model = C.fit_gbt(rows, maxIter=3, maxDepth=1, maxBins=64)
    return R.audit(model, rows).select("tree", "node", "feature", "threshold", "n", "mean", "impurity")


def grown(spark, folder):
    rows = documents(spark, folder).where("is_train")
    return settle(VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(rows).select("label", "features"))


@query("forest_certificate", f"SELECT tree::int AS tree, n, mean, true AS exact FROM range(20) AS t(tree), (SELECT count(*) AS n, avg(label) AS mean FROM ({TRAIN_SQL}))", "mean")
def forest_certificate(spark, folder):
    """Every share, impurity and gain that a forest of 20 trees states, against the labelled documents."""
    rows = grown(spark, folder)
    model = C.fit_forest(rows, numTrees=20, bootstrap=False, featureSubsetStrategy="sqrt")
    return R.certificate(R.audit(model, rows)).select("tree", "n", "mean", (F.col("gap") < 1e-9).alias("exact"))


@query("boosted_trees_certificate", f"SELECT tree::int AS tree, n, true AS exact FROM range(10) AS t(tree), (SELECT count(*) AS n FROM ({TRAIN_SQL}))")
def boosted_trees_certificate(spark, folder):
    """Every mean, impurity and gain that ten boosted trees state, against what the trees before leave of the labels."""
    rows = grown(spark, folder)
    model = C.fit_gbt(rows, maxIter=10, maxDepth=3)
    return R.certificate(R.audit(model, rows)).select("tree", "n", (F.col("gap") < 1e-9).alias("exact"))
