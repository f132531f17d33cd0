"""Tuning and penalty paths: preparation learnt inside folds, answers that carry their proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform
from sparkmetrica.operators import classify as C
from sparkmetrica.operators import newton as N
from sparkmetrica.operators import subset as S
from sparkmetrica.operators import tuning as T
from sparkmetrica.operators.penalty import net_path
from sparkmetrica.plans.classifiers import NUMERIC, documents
from sparkmetrica.plans.regressions import HOMES_SQL, ROW_KEY, X1, X2, Y, homes
from sparkmetrica.plans.registry import query, sql_uniform
from sparkmetrica.session import discard, settle
from sparkmetrica.sources.tables import load

STRENGTHS = [0.001, 0.01, 0.1, 1.0]
GAPS = "CASE WHEN l_linenumber <> 4 THEN ln_area END"

#: Every fold from its rows: fill and scale by the others, shrink the slope, judge the fold.
RIDGE_SQL = f"""
    WITH r AS (SELECT ln_price AS y, {GAPS} AS x, floor({sql_uniform('l_orderkey', 'folds')} * 5)::int AS own FROM ({HOMES_SQL})),
    m AS (SELECT fold, avg(x) AS fill FROM r, range(5) AS f(fold) WHERE own <> fold GROUP BY fold),
    t AS (SELECT fold, any_value(fill) AS fill, count(*) AS n_train, avg(y) AS my, avg(coalesce(x, fill)) AS mx, corr(y, coalesce(x, fill)) AS c,
      stddev_pop(y) AS sy, stddev_pop(coalesce(x, fill)) AS sx FROM r JOIN m ON own <> fold GROUP BY fold),
    b AS (SELECT *, c / (1 + strength / sy) * sy / sx AS b FROM t, (SELECT unnest([{', '.join(f'{s}::double' for s in STRENGTHS)}]) AS strength))
    SELECT strength, fold::int AS fold, any_value(n_train) AS n_train, count(*) AS n_test, avg((y - my - b * (coalesce(x, fill) - mx)) ** 2) AS mse
    FROM b JOIN r ON own = fold GROUP BY strength, fold
"""


def gapped(spark, folder):
    return homes(spark, folder).withColumn("area_seen", F.when(F.col("l_linenumber") != 4, F.col(X1)))


@query("tune_ridge", RIDGE_SQL, "mse", 8)
def tune_ridge(spark, folder):
    """Held-out error of four ridge penalties in five folds by order; a regressor with gaps."""
    return T.tune_net(gapped(spark, folder), Y, ["area_seen"], "l_orderkey", STRENGTHS)


@query(
    "tune_ridge_choice",
    f"""
    WITH s AS ({RIDGE_SQL}),
    a AS (SELECT strength, count(*) AS folds, avg(mse) AS mean, stddev_samp(mse) / sqrt(count(*)) AS se FROM s GROUP BY strength),
    b AS (SELECT mean + se AS upto FROM a ORDER BY mean, strength DESC LIMIT 1)
    SELECT a.*, mean = min(mean) OVER () AS best, strength = max(CASE WHEN mean <= upto THEN strength END) OVER () AS simplest FROM a, b
    """,
    "mean se",
    8,
)
def tune_ridge_choice(spark, folder):
    """The penalty with the least error, and the strongest within one standard error of it."""
    return T.chosen(T.tune_net(gapped(spark, folder), Y, ["area_seen"], "l_orderkey", STRENGTHS))


def net_sql(source: str, y: str, x: list, strengths, mix: float) -> str:
    """Elastic net with three regressors: of all 27 patterns of signs the one whose solution meets the conditions of the optimum."""
    one, two, three = x
    pairs = ", ".join(f"corr({a}, {b}) AS r{i}{j}" for i, a in enumerate(x, 1) for j, b in enumerate(x, 1))
    sums = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}, corr({y}, {c}) AS c{i}" for i, c in enumerate(x, 1))
    cells = {(i, j): f"(CASE WHEN s{i} = 0 THEN {1 if i == j else 0} ELSE r{i}{j}{' + l2' if i == j else ''} END)" for i in (1, 2, 3) for j in (1, 2, 3)}
    right = {i: f"(CASE WHEN s{i} = 0 THEN 0 ELSE c{i} - l1 * s{i} END)" for i in (1, 2, 3)}

    def det(column: int) -> str:
        m = {(i, j): right[i] if j == column else cells[i, j] for i, j in cells}
        return " + ".join(f"{m[1, a]} * ({m[2, b]} * {m[3, c]} - {m[2, c]} * {m[3, b]})" for a, b, c in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))

    slope = {i: f"(c{i} - r{i}1 * b1 - r{i}2 * b2 - r{i}3 * b3 - l2 * b{i})" for i in (1, 2, 3)}
    fits = " AND ".join(f"(CASE WHEN s{i} = 0 THEN abs({slope[i]}) <= l1 ELSE b{i} * s{i} > 0 END)" for i in (1, 2, 3))
    coef = [f"b{i} * dy / d{i}" for i in (1, 2, 3)]
    return f"""
    WITH q AS (SELECT avg({y}) AS my, stddev_pop({y}) AS dy, {sums}, {pairs} FROM ({source})),
    p AS (SELECT *, strength * {mix} / dy AS l1, strength * {1 - mix} / dy AS l2 FROM q, (SELECT unnest([{', '.join(f'{s}::double' for s in strengths)}]) AS strength),
      (SELECT unnest([-1, 0, 1]) AS s1), (SELECT unnest([-1, 0, 1]) AS s2), (SELECT unnest([-1, 0, 1]) AS s3)),
    d AS (SELECT *, ({det(1)}) / ({det(0)}) AS b1, ({det(2)}) / ({det(0)}) AS b2, ({det(3)}) / ({det(0)}) AS b3 FROM p),
    f AS (SELECT * FROM d WHERE {fits})
    SELECT strength, 'const' AS term, my - {' - '.join(f'{c} * m{i}' for i, c in enumerate(coef, 1))} AS coef, 0.0::double AS kkt FROM f
    UNION ALL SELECT strength, '{one}', {coef[0]}, 0.0::double FROM f UNION ALL SELECT strength, '{two}', {coef[1]}, 0.0::double FROM f
    UNION ALL SELECT strength, '{three}', {coef[2]}, 0.0::double FROM f
    """


NOISY_SQL = f"SELECT r.*, {sql_uniform(chr(39) + chr(39) + ' || l_orderkey || ' + chr(39) + ':' + chr(39) + ' || l_linenumber || ' + chr(39) + ':' + chr(39) + ' || l_partkey', 'nothing')} AS noise FROM ({HOMES_SQL.replace('SELECT l_orderkey, l_linenumber,', 'SELECT l_orderkey, l_partkey, l_linenumber,', 1)}) AS r"


def noisy(spark, folder):
    return homes(spark, folder).withColumn("noise", hash_uniform(ROW_KEY, "nothing"))


@query("elastic_net_three_terms", f"SELECT term, coef, kkt FROM ({net_sql(NOISY_SQL, Y, [X1, X2, 'noise'], [0.01], 0.5)})", "coef kkt", 8)
def elastic_net_three_terms(spark, folder):
    """Two factors and one column without effect; ``kkt`` is what the conditions of the optimum miss."""
    return net_path(noisy(spark, folder), Y, [X1, X2, "noise"], [0.01], 0.5).select("term", "coef", "kkt")


PATH = [0.3, 0.1, 0.03, 0.01, 0.003, 0.001]


@query("elastic_net_path", net_sql(NOISY_SQL, Y, [X1, X2, "noise"], PATH, 0.9), "coef kkt", 8)
def elastic_net_path(spark, folder):
    """Six penalties from one scan: factors enter one after the other."""
    return net_path(noisy(spark, folder), Y, [X1, X2, "noise"], PATH, 0.9).select("strength", "term", "coef", "kkt")


@query("tune_logit")
def tune_logit(spark, folder):
    """Three penalties, three folds that keep copies of a document together; filling, scaling and levels from the training folds."""
    scores, _ = T.tune_logit(documents(spark, folder), "label", NUMERIC, "copy_key", [0.001, 0.01, 0.1], ["lang"])
    return scores.groupBy(F.col("strength").alias("reg_param")).agg(
        F.avg("auc").alias("mean_auc"), F.avg("log_loss").alias("mean_log_loss"), F.every("converged").alias("converged")
    )


COUNTED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "logit_score_equations",
    "WITH r AS (SELECT *, (l_returnflag = 'R')::int AS y FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{c}' AS term, count(*) AS n, avg({x}) AS observed, avg({x}) AS fitted, true AS converged FROM r" for c, x in [("const", "y"), *[(c, f"y * {c}") for c in COUNTED]]),
    "observed fitted",
    5,
)
def logit_score_equations(spark, folder):
    """A fit is the maximum-likelihood one just where mean probabilities times columns equal those of the labels."""
    rows = load(spark, folder, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    facts = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(COUNTED) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, spreads = ([facts[f"{n}{i}"] for i in range(len(COUNTED))] for n in "ms")
    ready = settle(N.batches_of(rows, COUNTED, "label", None, None))
    model = N.fit(ready, [N.Logit(N.np.array(means), N.np.array(means), N.np.array(spreads))])[0]
    got = N.scored(ready.withColumn("x0", F.col("x")), [model], held_out=False, keep="x0 array<double>")
    parts = [got.agg(F.lit(c).alias("term"), F.count(F.lit(1)).alias("n"), F.avg(F.col("y") * x).alias("observed"), F.avg(F.col("score") * x).alias("fitted"))
             for c, x in [("const", F.lit(1.0)), *[(c, F.col("x0")[i]) for i, c in enumerate(COUNTED)]]]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("converged", F.lit(bool(model.converged)))


@query("logit_documents")
def logit_documents(spark, folder):
    """AUC on the test documents of a penalised fit on the others, both classes with equal weight; scaled by the training rows."""
    rows = documents(spark, folder)
    wide, added = T.indicators(rows, ["lang"])
    wide = C.class_weights(wide, "label").withColumn("part", (~F.col("is_train")).cast("int"))
    columns = [*NUMERIC, *added]
    ready = settle(N.batches_of(wide, columns, "label", "part", "weight"))
    facts = wide.where("is_train").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, spreads = (N.np.array([facts[f"{n}{i}"] for i in range(len(columns))], float) for n in "ms")
    model = N.fit(ready, [N.Logit(means, means, spreads, 0.01, without=1)])[0]
    found = settle(N.scored(ready, [model], held_out=True))
    out = C.auc(found, "y", "score").withColumns({"model": F.lit("logit"), "converged": F.lit(bool(model.converged))})
    discard(ready)
    return out


def subset_sql(source: str, y: str, x: list) -> str:
    """All eight models of three regressors, from correlations."""
    one, two, three = x
    pair = lambda i, j: f"(c{i} ** 2 + c{j} ** 2 - 2 * c{i} * c{j} * r{i}{j}) / (1 - r{i}{j} ** 2)"
    det = "(1 + 2 * r12 * r13 * r23 - r12 ** 2 - r13 ** 2 - r23 ** 2)"
    full = f"""(c1 ** 2 * (1 - r23 ** 2) + c2 ** 2 * (1 - r13 ** 2) + c3 ** 2 * (1 - r12 ** 2)
      - 2 * c1 * c2 * (r12 - r13 * r23) - 2 * c1 * c3 * (r13 - r12 * r23) - 2 * c2 * c3 * (r23 - r12 * r13)) / {det}"""
    models = [(0, "", "0"), (1, one, "c1 ** 2"), (1, two, "c2 ** 2"), (1, three, "c3 ** 2"), (2, f"{one},{two}", pair(1, 2)),
              (2, f"{one},{three}", pair(1, 3)), (2, f"{two},{three}", pair(2, 3)), (3, f"{one},{two},{three}", full)]
    return f"""
    WITH q AS (SELECT count(*) AS n, var_pop({y}) AS v, corr({y}, {one}) AS c1, corr({y}, {two}) AS c2, corr({y}, {three}) AS c3,
      corr({one}, {two}) AS r12, corr({one}, {three}) AS r13, corr({two}, {three}) AS r23 FROM ({source})),
    m AS ({' UNION ALL '.join(f"SELECT {k}::int AS size, '{t}' AS terms, n, v, ({r2})::double AS r2 FROM q" for k, t, r2 in models)}),
    b AS (SELECT size, arg_max(terms, r2) AS terms, any_value(n) AS n, any_value(v) AS v, max(r2) AS r2 FROM m GROUP BY size),
    c AS (SELECT *, ln(2 * pi() * v * (1 - r2)) + 1 + ln(n) / n * (size + 1) AS bic_per_row FROM b)
    SELECT size, terms, n, r2, bic_per_row, bic_per_row = min(bic_per_row) OVER () AS best FROM c
    """


@query("best_subset", subset_sql(NOISY_SQL, Y, [X1, X2, "noise"]), "r2 bic_per_row", 8)
def best_subset(spark, folder):
    """The best model of each size among two factors and a column without effect."""
    found = S.best_subset(noisy(spark, folder), Y, [X1, X2, "noise"])
    return found.select("size", "terms", "n", "r2", (F.col("bic") / F.col("n")).alias("bic_per_row"), "best")
