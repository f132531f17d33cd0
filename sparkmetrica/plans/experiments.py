"""A/B experiment queries on the event table: users are the units."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from sparkmetrica.functions.dist import p_norm
from sparkmetrica.operators import experiment as E
from sparkmetrica.operators.hypothesis import ttest
from sparkmetrica.plans.registry import query, sql_p_chi2, sql_p_norm, sql_p_t, sql_uniform
from sparkmetrica.sources.tables import load

UNITS_SQL = f"""
    SELECT user_id, sum(value) AS y, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS clicks,
      count(*) FILTER (event_type = 'view') AS views, (count(*) FILTER (event_type = 'purchase') >= 13)::int::double AS bought,
      coalesce(sum(value) FILTER (ts < timestamp '2024-01-11'), 0) AS pre, coalesce(sum(value) FILTER (ts >= timestamp '2024-01-11'), 0) AS post,
      (CASE WHEN {sql_uniform('user_id', 'exp1')} < 0.5 THEN 0 ELSE 1 END)::int AS arm
    FROM events GROUP BY user_id
"""


def units(spark, folder):
    """One row per user that has events, with metrics and the arm of experiment exp1."""
    early = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    metrics = {
        "y": F.sum("value"),
        "n_events": F.count(F.lit(1)),
        "clicks": F.count_if(F.col("event_type") == "click"),
        "views": F.count_if(F.col("event_type") == "view"),
        "bought": (F.count_if(F.col("event_type") == "purchase") >= 13).cast("double"),
        "pre": F.coalesce(F.sum(F.when(early, F.col("value"))), F.lit(0.0)),
        "post": F.coalesce(F.sum(F.when(~early, F.col("value"))), F.lit(0.0)),
    }
    return E.assign(E.unit_metrics(load(spark, folder, "events"), "user_id", metrics), "user_id", "exp1")


def arms_sql(columns: str, table: str = "u") -> str:
    """Aggregates of both arms: ``{{a}}`` in ``columns`` becomes the arm's filter."""
    both = ", ".join(columns.replace("{a}", f"FILTER (arm = {i})").replace("#", str(i)) for i in (0, 1))
    return f"SELECT {both} FROM {table}"


def welch_sql(y: str, extra: str = "") -> str:
    return f"""
    WITH u AS ({UNITS_SQL}),
    s AS ({arms_sql(f"count({y}) {{a}} AS n#, avg({y}) {{a}} AS mean#, var_samp({y}) {{a}} AS var#")}),
    w AS (SELECT n0, n1, mean0, mean1, mean1 - mean0 AS diff, sqrt(var0 / n0 + var1 / n1) AS se,
      (var0 / n0 + var1 / n1) ** 2 / ((var0 / n0) ** 2 / (n0 - 1) + (var1 / n1) ** 2 / (n1 - 1)) AS df FROM s)
    SELECT n0, n1, mean0, mean1, diff, se, df, diff / se AS t, {sql_p_t('diff / se', 'df')} AS p FROM w
    """


WELCH = ["n0", "n1", "mean0", "mean1", "diff", "se", "df", "t", "p"]


@query("ab_welch", welch_sql("y"), "mean0 mean1 diff se df t p")
def ab_welch(spark, folder):
    """Total value per user, two arms."""
    return ttest(units(spark, folder), "y", "arm").select(*WELCH)


@query(
    "assign_three_arms",
    f"""
    SELECT (CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END)::int AS arm, count(*) AS n, avg(c_acctbal) AS balance
    FROM (SELECT *, {sql_uniform('c_custkey', 'price-test')} AS u FROM customer) GROUP BY 1
    """,
    "balance",
)
def assign_three(spark, folder):
    arms = E.assign(load(spark, folder, "customer"), "c_custkey", "price-test", (0.5, 0.3, 0.2))
    return arms.groupBy("arm").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))


@query(
    "sample_ratio",
    f"""
    WITH c AS (SELECT (CASE WHEN {sql_uniform('c_custkey', 'price-test')} < 0.5 THEN 0 ELSE 1 END) AS arm FROM customer),
    s AS (SELECT count(*) AS n, count(*) FILTER (arm = 0) AS a, count(*) FILTER (arm = 1) AS b FROM c),
    x AS (SELECT n, (a - n / 2.0::double) ** 2 / (n / 2.0::double) + (b - n / 2.0::double) ** 2 / (n / 2.0::double) AS chi2 FROM s)
    SELECT n, 0::bigint AS n_unexpected, chi2, 1::int AS df, {sql_p_chi2('chi2', '1')} AS p FROM x
    """,
    "chi2 p",
)
def sample_ratio(spark, folder):
    return E.srm(E.assign(load(spark, folder, "customer"), "c_custkey", "price-test"), "arm")


@query(
    "sample_ratio_unplanned_arm",
    f"""
    WITH c AS (SELECT {sql_uniform('c_custkey', 'price-test')} AS u FROM customer),
    s AS (SELECT count(*) FILTER (u < 0.8) AS n, count(*) FILTER (u >= 0.8) AS n_unexpected, count(*) FILTER (u < 0.5) AS a, count(*) FILTER (u >= 0.5 AND u < 0.8) AS b FROM c)
    SELECT n, n_unexpected, ((a - n / 2.0::double) ** 2 + (b - n / 2.0::double) ** 2) / (n / 2.0::double) AS chi2, 1::int AS df,
      CASE WHEN n_unexpected > 0 THEN 0::double END AS p FROM s
    """,
    "chi2 p",
)
def sample_ratio_unplanned_arm(spark, folder):
    """Two arms planned, three found: the check must fail."""
    return E.srm(E.assign(load(spark, folder, "customer"), "c_custkey", "price-test", (0.5, 0.3, 0.2)), "arm")


@query(
    "unit_metrics",
    """
    SELECT c_custkey AS user_id, coalesce(sum(value), 0) AS total, count(event_id) AS n_events,
      count(event_id) FILTER (event_type = 'purchase') AS purchases
    FROM customer LEFT JOIN events ON user_id = c_custkey AND ts >= timestamp '2024-01-08' AND ts < timestamp '2024-01-22' GROUP BY 1
    """,
    "total",
    digits=4,
)
def unit_metrics(spark, folder):
    """All customers are assigned; those without events in the window keep zeros."""
    ts = F.col("ts")
    window = (ts >= F.lit("2024-01-08").cast("timestamp_ntz")) & (ts < F.lit("2024-01-22").cast("timestamp_ntz"))
    assigned = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    metrics = {
        "total": F.sum("value"), "n_events": F.count(F.lit(1)), "purchases": F.count_if(F.col("event_type") == "purchase"),
    }
    return E.unit_metrics(load(spark, folder, "events"), "user_id", metrics, assigned, window)


@query(
    "ab_proportion",
    f"""
    WITH u AS ({UNITS_SQL}), s AS ({arms_sql("count(bought) {a} AS n#, avg(bought) {a} AS p#")}),
    q AS (SELECT *, (n0 * p0 + n1 * p1) / (n0 + n1) AS q FROM s),
    z AS (SELECT n0, n1, p0, p1, (p1 - p0) / sqrt(q * (1 - q) * (1.0::double / n0 + 1.0::double / n1)) AS z FROM q)
    SELECT n0, n1, p0, p1, z, {sql_p_norm('z')} AS p FROM z
    """,
    "p0 p1 z p",
)
def ab_proportion(spark, folder):
    from sparkmetrica.operators.hypothesis import prop_ztest

    return prop_ztest(units(spark, folder), "bought", "arm").select("n0", "n1", "p0", "p1", "z", "p")


def _poisson_sql(u: str) -> str:
    cuts, mass, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += mass
        cuts.append(f"({u} >= {total!r}::double)::int")
        mass /= k + 1
    return " + ".join(cuts)


def _reps_sql(B: int, seed: str) -> str:
    u = sql_uniform("rep || ':' || user_id", seed)
    return f"""
    WITH u AS ({UNITS_SQL}),
    h AS (SELECT user_id, arm, y, clicks, views, rep, {u} AS h FROM u, range(1, {B + 1}) AS r(rep)),
    w AS (SELECT *, {_poisson_sql('h')} AS w FROM h)
    """


SUMMARY_SQL = """
    SELECT count(diff) AS reps, avg(diff) AS mean_diff, stddev_samp(diff) AS se,
      quantile_cont(diff, 0.025) AS ci_lo, quantile_cont(diff, 0.975) AS ci_hi FROM d
"""


@query(
    "bootstrap_mean",
    _reps_sql(100, "boot")
    + """, d AS (SELECT rep, sum(w * y) FILTER (arm = 1) / nullif(sum(w) FILTER (arm = 1), 0) - sum(w * y) FILTER (arm = 0) / nullif(sum(w) FILTER (arm = 0), 0) AS diff
      FROM w GROUP BY rep)"""
    + SUMMARY_SQL,
    "mean_diff se ci_lo ci_hi",
)
def bootstrap_mean(spark, folder):
    return E.bootstrap(units(spark, folder), "user_id", "arm", "y", 100)


@query(
    "bootstrap_ratio",
    _reps_sql(100, "ratio")
    + """, d AS (SELECT rep, sum(w * clicks) FILTER (arm = 1) / nullif(sum(w * views) FILTER (arm = 1), 0)::double
      - sum(w * clicks) FILTER (arm = 0) / nullif(sum(w * views) FILTER (arm = 0), 0)::double AS diff FROM w GROUP BY rep)"""
    + SUMMARY_SQL,
    "mean_diff se ci_lo ci_hi",
)
def bootstrap_ratio(spark, folder):
    return E.bootstrap(units(spark, folder), "user_id", "arm", "clicks", 100, "ratio", "ratio", den="views")


@query(
    "bootstrap_median",
    _reps_sql(50, "med")
    + """, m AS (SELECT rep, arm, median(y) AS q FROM (SELECT rep, arm, y, unnest(range(w)) FROM w) GROUP BY 1, 2),
    d AS (SELECT rep, max(q) FILTER (arm = 1) - max(q) FILTER (arm = 0) AS diff FROM m GROUP BY rep)"""
    + SUMMARY_SQL,
    "mean_diff se ci_lo ci_hi",
)
def bootstrap_median(spark, folder):
    return E.bootstrap(units(spark, folder), "user_id", "arm", "y", 50, "med", "median")


@query(
    "permutation_test",
    f"""
    WITH u AS ({UNITS_SQL}),
    o AS (SELECT avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS diff, count(*) FILTER (arm = 1) AS n1 FROM u),
    h AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {sql_uniform("rep || ':' || user_id", "perm")}, user_id) AS i
      FROM u, range(1, 101) AS r(rep)),
    d AS (SELECT rep, avg(y) FILTER (i <= n1) - avg(y) FILTER (i > n1) AS d, any_value(diff) AS diff FROM h, o GROUP BY rep)
    SELECT any_value(diff) AS diff, count(*) AS reps, count(*) FILTER (abs(d) >= abs(diff)) AS extreme,
      (count(*) FILTER (abs(d) >= abs(diff)) + 1) / (count(*) + 1)::double AS p FROM d
    """,
    "diff p",
)
def permutation(spark, folder):
    return E.permutation_test(units(spark, folder), "user_id", "arm", "y", 100)


@query(
    "cuped",
    f"""
    WITH u AS ({UNITS_SQL}), th AS (SELECT covar_samp(post, pre) / var_samp(pre) AS theta, avg(pre) AS g FROM u),
    v AS (SELECT arm, post, post - theta * (pre - g) AS y, theta FROM u, th),
    s AS ({arms_sql("count(y) {a} AS n#, avg(y) {a} AS mean#, var_samp(y) {a} AS var#, var_samp(post) {a} AS raw#", "v")}),
    w AS (SELECT n0, n1, mean0, mean1, mean1 - mean0 AS diff, sqrt(var0 / n0 + var1 / n1) AS se, sqrt(raw0 / n0 + raw1 / n1) AS raw_se,
      (var0 / n0 + var1 / n1) ** 2 / ((var0 / n0) ** 2 / (n0 - 1) + (var1 / n1) ** 2 / (n1 - 1)) AS df FROM s)
    SELECT (SELECT theta FROM th) AS theta, n0, n1, mean0, mean1, raw_se, diff, se, df, diff / se AS t, {sql_p_t('diff / se', 'df')} AS p FROM w
    """,
    "theta mean0 mean1 raw_se diff se df t p",
)
def cuped(spark, folder):
    got = E.cuped(units(spark, folder), "arm", "post", "pre")
    return got.select("theta", "n0", "n1", "mean0", "mean1", "raw_se", "diff", "se", "df", "t", "p")


@query(
    "ratio_metric",
    f"""
    WITH u AS ({UNITS_SQL}), r AS (SELECT arm, sum(clicks) / sum(views)::double AS r, avg(views) AS d, count(*) AS n FROM u GROUP BY arm),
    v AS (SELECT arm, any_value(r) AS r, var_samp(clicks - r * views) / (any_value(n) * any_value(d) ** 2) AS v, any_value(n) AS n FROM u JOIN r USING (arm) GROUP BY arm),
    s AS (SELECT max(n) FILTER (arm = 0) AS n0, max(n) FILTER (arm = 1) AS n1, max(r) FILTER (arm = 0) AS ratio0, max(r) FILTER (arm = 1) AS ratio1,
      sqrt(sum(v)) AS se FROM v),
    z AS (SELECT *, (ratio1 - ratio0) / se AS z FROM s)
    SELECT n0, n1, ratio0, ratio1, se, ratio1 - ratio0 AS diff, z, {sql_p_norm('z')} AS p FROM z
    """,
    "ratio0 ratio1 se diff z p",
)
def ratio_metric(spark, folder):
    got = E.ratio_test(units(spark, folder), "arm", "clicks", "views")
    return got.select("n0", "n1", "ratio0", "ratio1", "se", "diff", "z", "p")


def with_segment(spark, folder):
    """Users with the market segment of the customer of the same number."""
    segments = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    return units(spark, folder).join(segments, "user_id", "left")


SEGMENT_SQL = f"SELECT u.*, c_mktsegment, c_nationkey FROM ({UNITS_SQL}) u LEFT JOIN customer ON c_custkey = user_id"


@query(
    "stratified",
    f"""
    WITH u AS ({SEGMENT_SQL}),
    g AS (SELECT c_mktsegment AS g, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1) AS n1,
      avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS d,
      var_samp(y) FILTER (arm = 1) / count(*) FILTER (arm = 1) + var_samp(y) FILTER (arm = 0) / count(*) FILTER (arm = 0) AS v FROM u GROUP BY 1),
    k AS (SELECT *, (n0 + n1)::double AS n, n0 >= 2 AND n1 >= 2 AS ok FROM g),
    s AS (SELECT count(*) FILTER (ok) AS strata, coalesce(sum(n) FILTER (NOT ok), 0)::bigint AS n_unused,
      sum(n * d) FILTER (ok) / sum(n) FILTER (ok) AS diff, sqrt(sum(n * n * v) FILTER (ok)) / sum(n) FILTER (ok) AS se FROM k)
    SELECT strata, n_unused, diff, se, diff / se AS z, {sql_p_norm('diff / se')} AS p FROM s
    """,
    "diff se z p",
)
def stratified(spark, folder):
    got = E.stratified_test(with_segment(spark, folder), "arm", "y", "c_mktsegment")
    return got.select("strata", "n_unused", "diff", "se", "z", "p")


def _report_sql(metric: str, segment: str | None) -> str:
    name, level = (segment, f"{segment}::varchar") if segment else ("all", "NULL::varchar")
    group = f"GROUP BY {segment}" if segment else ""
    return f"""
    SELECT 1::int AS arm, '{name}' AS segment, {level} AS level, '{metric}' AS metric,
      count(*) FILTER (arm = 0) AS a0, count(*) FILTER (arm = 1) AS a1, count({metric}) FILTER (arm = 0) AS n0, count({metric}) FILTER (arm = 1) AS n1,
      avg({metric}) FILTER (arm = 0) AS mean0, avg({metric}) FILTER (arm = 1) AS mean1,
      var_samp({metric}) FILTER (arm = 0) AS var0, var_samp({metric}) FILTER (arm = 1) AS var1 FROM u {group}
    """


@query(
    "ab_report",
    f"WITH u AS ({SEGMENT_SQL}), s AS ("
    + " UNION ALL ".join(_report_sql(m, s) for m in ("y", "n_events", "bought") for s in (None, "c_mktsegment", "c_nationkey"))
    + """), w AS (SELECT * REPLACE (CASE WHEN a1 > 0 THEN arm END AS arm, CASE WHEN a0 > 0 THEN n0 END AS n0, CASE WHEN a1 > 0 THEN n1 END AS n1), mean1 - mean0 AS diff, sqrt(var0 / n0 + var1 / n1) AS se FROM s)
    SELECT arm, segment, level, metric, n0, n1, mean0, mean1, diff, se, CASE WHEN se > 0 THEN diff / se END AS t,
      CASE WHEN mean0 <> 0 THEN diff / mean0 END AS lift FROM w""",
    "mean0 mean1 diff se t lift",
)
def ab_report(spark, folder):
    """Three metrics, in total and by two segment columns, in one pass over the users."""
    got = E.ab_report(with_segment(spark, folder), "arm", ["y", "n_events", "bought"], ["c_mktsegment", "c_nationkey"])
    columns = ["arm", "segment", "level", "metric", "n0", "n1", "mean0", "mean1", "diff", "se", "t", "lift"]
    return got.select(*columns)


@query(
    "ab_report_missing_arms",
    """
    WITH u AS (SELECT CASE WHEN c_nationkey < 3 THEN 0 WHEN c_nationkey < 6 THEN 1 ELSE c_custkey % 2 END AS arm, c_nationkey AS g, c_acctbal AS y FROM customer),
    s AS (SELECT 'all' AS segment, NULL::varchar AS level, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1) AS n1, avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS diff FROM u
      UNION ALL SELECT 'c_nationkey', g::varchar, count(*) FILTER (arm = 0), count(*) FILTER (arm = 1), avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) FROM u GROUP BY g)
    SELECT CASE WHEN n1 > 0 THEN 1 END::bigint AS arm, segment, level, 'c_acctbal' AS metric, nullif(n0, 0) AS n0, nullif(n1, 0) AS n1, diff FROM s
    """,
    "diff",
)
def ab_report_missing_arms(spark, folder):
    """Nations of which all customers are in one arm keep their rows."""
    arm = F.when(F.col("c_nationkey") < 3, F.lit(0)).when(F.col("c_nationkey") < 6, F.lit(1)).otherwise(F.col("c_custkey") % 2)
    rows = load(spark, folder, "customer").withColumn("arm", arm)
    return E.ab_report(rows, "arm", ["c_acctbal"], ["c_nationkey"]).select("arm", "segment", "level", "metric", "n0", "n1", "diff")


@query(
    "ab_report_many_arms",
    f"""
    WITH c AS (SELECT *, (CASE WHEN {sql_uniform('c_custkey', 'price-test')} < 0.5 THEN 0 WHEN {sql_uniform('c_custkey', 'price-test')} < 0.8 THEN 1 ELSE 2 END)::int AS arm FROM customer),
    s AS (SELECT arm, count(c_acctbal) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM c GROUP BY arm)
    SELECT a.arm, b.n AS n0, a.n AS n1, a.m - b.m AS diff, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t
    FROM s a JOIN s b ON b.arm = 0 AND a.arm <> 0
    """,
    "diff t",
)
def ab_report_many_arms(spark, folder):
    arms = E.assign(load(spark, folder, "customer"), "c_custkey", "price-test", (0.5, 0.3, 0.2))
    return E.ab_report(arms, "arm", ["c_acctbal"]).select("arm", "n0", "n1", "diff", "t")


# one z-test per supplier: is its mean discount 5 percent?
P_SQL = f"""
    SELECT l_suppkey, {sql_p_norm('z')} AS p FROM (
      SELECT l_suppkey, (avg(l_discount) - 0.05) / sqrt(var_samp(l_discount) / count(*)) AS z FROM lineitem GROUP BY 1)
"""


def supplier_p(spark, folder):
    z = (F.avg("l_discount") - 0.05) / F.sqrt(F.var_samp("l_discount") / F.count(F.lit(1)))
    rows = load(spark, folder, "lineitem").groupBy("l_suppkey").agg(z.alias("z"))
    return rows.select("l_suppkey", p_norm(F.col("z")).alias("p"))


@query("adjust_p_bh", f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS i, count(*) OVER () AS m FROM p)
    SELECT l_suppkey, p, least(1, min(p * m / i) OVER (ORDER BY i DESC)) AS p_adj FROM r""", "p p_adj")
def adjust_bh(spark, folder):
    return E.adjust_p(supplier_p(spark, folder), "p", "bh", "l_suppkey")


@query("adjust_p_holm", f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS i, count(*) OVER () AS m FROM p)
    SELECT l_suppkey, p, least(1, max(p * (m - i + 1)) OVER (ORDER BY i)) AS p_adj FROM r""", "p p_adj")
def adjust_holm(spark, folder):
    return E.adjust_p(supplier_p(spark, folder), "p", "holm", "l_suppkey")


@query("adjust_p_bonferroni", f"WITH p AS ({P_SQL}) SELECT l_suppkey, p, least(1, p * count(*) OVER ()) AS p_adj FROM p", "p p_adj")
def adjust_bonferroni(spark, folder):
    return E.adjust_p(supplier_p(spark, folder), "p", "bonferroni")


def _z(p: float) -> str:
    return f"{NormalDist().inv_cdf(p)!r}::double"


@query(
    "power_table",
    f"WITH u AS ({UNITS_SQL}), s AS (SELECT count(y) AS n, avg(y) AS m, var_samp(y) AS v FROM u) "
    + " UNION ALL ".join(
        f"""SELECT {e}::double AS effect, {a}::double AS alpha, {b}::double AS power, m AS mean, sqrt(v) AS sd,
        ceil(2 * ({_z(1 - a / 2)} + {_z(b)}) ** 2 * v / ({e} * m) ** 2)::bigint AS n_per_arm,
        ({_z(1 - a / 2)} + {_z(b)}) * sqrt(4 * v / n) AS mde, ({_z(1 - a / 2)} + {_z(b)}) * sqrt(4 * v / n) / m AS mde_relative FROM s"""
        for e in (0.01, 0.02, 0.05) for a in (0.01, 0.05) for b in (0.8, 0.9)
    ),
    "mean sd mde mde_relative",
)
def power_table(spark, folder):
    return E.power_table(units(spark, folder), "y", (0.01, 0.02, 0.05), (0.01, 0.05), (0.8, 0.9))


@query(
    "aa_check",
    f"""
    WITH u AS ({UNITS_SQL}),
    h AS (SELECT salt, y, {sql_uniform("salt || ':' || user_id", "aa")} < 0.5 AS c FROM u, range(0, 60) AS r(salt)),
    s AS (SELECT salt, count(*) FILTER (c) AS n0, count(*) FILTER (NOT c) AS n1, avg(y) FILTER (NOT c) - avg(y) FILTER (c) AS d,
      var_samp(y) FILTER (c) / count(*) FILTER (c) AS a, var_samp(y) FILTER (NOT c) / count(*) FILTER (NOT c) AS b FROM h GROUP BY salt),
    t AS (SELECT d / sqrt(a + b) AS t, (a + b) ** 2 / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS df FROM s),
    p AS (SELECT {sql_p_t('t', 'df')} AS p FROM t)
    SELECT count(p) AS tests, count(*) FILTER (p < 0.05) AS rejected, avg((p < 0.05)::int) AS rate FROM p
    """,
    "rate",
)
def aa_check(spark, folder):
    return E.aa_check(units(spark, folder), "user_id", "y", 60).select("tests", "rejected", "rate")
