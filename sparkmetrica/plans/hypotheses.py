"""Hypothesis-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmetrica.operators import hypothesis as H
from sparkmetrica.operators.order import avg_rank
from sparkmetrica.plans.registry import query, sql_p_chi2, sql_p_f, sql_p_norm, sql_p_t
from sparkmetrica.sources.tables import load

ONE_SQL = f"""
    SELECT n, diff, se, diff / se AS t, n - 1.0::double AS df, {sql_p_t('diff / se', 'n - 1')} AS p
    FROM (SELECT count(*) AS n, avg({{d}}) AS diff, sqrt(var_samp({{d}}) / count(*)) AS se FROM {{table}})
"""


@query("ttest_one_sample", ONE_SQL.format(d="l_discount - 0.05", table="lineitem"), "diff se t df p", 7)
def ttest_one(spark, folder):
    return H.ttest(load(spark, folder, "lineitem"), "l_discount", kind="one", mu=0.05).select("n", "diff", "se", "t", "df", "p")


@query("ttest_paired", ONE_SQL.format(d="l_discount - l_tax - 0.01", table="lineitem"), "diff se t df p", 7)
def ttest_paired(spark, folder):
    """Discount against tax plus one point, row by row."""
    rows = load(spark, folder, "lineitem").withColumn("tax1", F.col("l_tax") + 0.01)
    return H.ttest(rows, "l_discount", kind="paired", other="tax1").select("n", "diff", "se", "t", "df", "p")


@query(
    "ttest_pooled",
    f"""
    WITH s AS (SELECT count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n0,
      avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F') AS diff,
      var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v1, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v0 FROM lineitem),
    u AS (SELECT n0, n1, diff, (n0 + n1 - 2)::double AS df,
      sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n0 + n1 - 2) * (1.0::double / n0 + 1.0::double / n1)) AS se FROM s)
    SELECT n0, n1, diff, se, diff / se AS t, df, {sql_p_t('diff / se', 'df')} AS p FROM u
    """,
    "diff se t df p",
)
def ttest_pooled(spark, folder):
    got = H.ttest(load(spark, folder, "lineitem"), "l_quantity", "l_linestatus", "pooled", arms=("F", "O"))
    return got.select("n0", "n1", "diff", "se", "t", "df", "p")


@query(
    "prop_ztest_one",
    f"""
    SELECT n, p1, p1 - 0.5 AS diff, z, {sql_p_norm('z')} AS p FROM (
      SELECT count(*) AS n, avg((l_linestatus = 'O')::int) AS p1,
        (avg((l_linestatus = 'O')::int) - 0.5) / sqrt(0.25 / count(*)) AS z FROM lineitem)
    """,
    "p1 diff z p",
)
def prop_one(spark, folder):
    rows = load(spark, folder, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("double"))
    return H.prop_ztest(rows, "open").select("n", "p1", "diff", "z", "p")


@query(
    "prop_ztest_two",
    f"""
    WITH s AS (SELECT count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n0,
      avg((l_returnflag = 'R')::int) FILTER (l_linestatus = 'O') AS p1, avg((l_returnflag = 'R')::int) FILTER (l_linestatus = 'F') AS p0,
      avg((l_returnflag = 'R')::int) AS q FROM lineitem),
    u AS (SELECT *, (p1 - p0) / sqrt(q * (1 - q) * (1.0::double / n0 + 1.0::double / n1)) AS z,
      1.959963984540054 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS half FROM s)
    SELECT n0, n1, p0, p1, p1 - p0 AS diff, z, {sql_p_norm('z')} AS p, p1 - p0 - half AS ci_lo, p1 - p0 + half AS ci_hi FROM u
    """,
    "p0 p1 diff z p ci_lo ci_hi",
)
def prop_two(spark, folder):
    rows = load(spark, folder, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    return H.prop_ztest(rows, "returned", "l_linestatus", arms=("F", "O"))


@query(
    "chi2_independence",
    f"""
    WITH c AS (SELECT a, b, count(x.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority AS a FROM orders)
        CROSS JOIN (SELECT DISTINCT o_orderstatus AS b FROM orders)
        LEFT JOIN orders x ON x.o_orderpriority = a AND x.o_orderstatus = b GROUP BY 1, 2),
    e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER ()::double AS e FROM c),
    s AS (SELECT sum(n)::bigint AS n, sum((n - e) ** 2 / e) AS chi2 FROM e),
    k AS (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS m FROM c)
    SELECT n, chi2, df, sqrt(chi2 / (n * m)) AS cramers_v, {sql_p_chi2('chi2', 'df')} AS p FROM s, k
    """,
    "chi2 cramers_v p",
)
def chi2_independence(spark, folder):
    return H.chi2_test(load(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "chi2_goodness_of_fit",
    f"""
    WITH c AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1),
    e AS (SELECT f, n, (CASE f WHEN 'A' THEN 0.33 WHEN 'N' THEN 0.34 ELSE 0.33 END)::double * sum(n) OVER () AS e FROM c),
    s AS (SELECT sum(n)::bigint AS n, sum((n - e) ** 2 / e) AS chi2, (count(*) - 1)::int AS df FROM e)
    SELECT n, 0::bigint AS n_unexpected, chi2, df, {sql_p_chi2('chi2', 'df')} AS p FROM s
    """,
    "chi2 p",
)
def chi2_gof(spark, folder):
    return H.chi2_gof(load(spark, folder, "lineitem"), "l_returnflag", {"A": 0.33, "N": 0.34, "R": 0.33})


@query(
    "chi2_features",
    f"""
    WITH one AS (
      SELECT 0 AS f, l_linenumber::double AS x, (l_returnflag = 'R') AS y FROM lineitem
      UNION ALL SELECT 1, l_quantity, (l_returnflag = 'R') FROM lineitem),
    c AS (SELECT f, x, y, count(*) AS n FROM one GROUP BY 1, 2, 3),
    r AS (SELECT f, x, sum(n) AS rx FROM c GROUP BY 1, 2), t AS (SELECT f, y, sum(n) AS ry FROM c GROUP BY 1, 2),
    a AS (SELECT f, sum(n) AS n FROM c GROUP BY 1),
    e AS (SELECT r.f, coalesce(c.n, 0) AS n, rx * ry / a.n::double AS e FROM r JOIN t ON r.f = t.f JOIN a ON a.f = r.f
          LEFT JOIN c ON c.f = r.f AND c.x = r.x AND c.y = t.y)
    SELECT f::int AS "featureIndex", sum((n - e) ** 2 / e) AS statistic, (count(*) // 2 - 1)::int AS "degreesOfFreedom", 0::bigint AS n_dropped FROM e GROUP BY f
    """,
    "statistic",
    digits=5,
)
def chi2_features(spark, folder):
    """Spark ML's test of two discrete columns against the return flag."""
    rows = load(spark, folder, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    return H.chi2_feature_test(rows, ["l_linenumber", "l_quantity"], "label").drop("pValue")


ANOVA_TAIL = f"""
    SELECT n, k, df1, df2, f, ss_between / (ss_between + ss_within) AS eta2, {sql_p_f('f', 'df1', 'df2')} AS p
    FROM (SELECT *, (ss_between / df1) / (ss_within / df2) AS f FROM a)
"""


def anova_sql(rows: str) -> str:
    """Textbook sums of squares of rows ``(g, y)``."""
    return f"""
    WITH r AS ({rows}),
    d AS (SELECT g, y, avg(y) OVER (PARTITION BY g) AS m, avg(y) OVER () AS mm FROM r),
    a AS (SELECT count(*) AS n, count(DISTINCT g) AS k, count(DISTINCT g) - 1 AS df1, count(*) - count(DISTINCT g) AS df2,
      sum((m - mm) ** 2) AS ss_between, sum((y - m) ** 2) AS ss_within FROM d)
    {ANOVA_TAIL}
    """


@query("anova", anova_sql("SELECT c_mktsegment AS g, c_acctbal AS y FROM customer"), "f eta2 p")
def anova(spark, folder):
    return H.anova(load(spark, folder, "customer"), "c_mktsegment", "c_acctbal").drop("ss_between", "ss_within")


@query(
    "levene_mean",
    anova_sql("SELECT c_mktsegment AS g, abs(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS y FROM customer"),
    "f eta2 p",
)
def levene_mean(spark, folder):
    return H.levene(load(spark, folder, "customer"), "c_mktsegment", "c_acctbal", "mean").drop("ss_between", "ss_within")


@query(
    "brown_forsythe",
    anova_sql("SELECT event_type AS g, abs(value - median(value) OVER (PARTITION BY event_type)) AS y FROM events"),
    "f eta2 p",
)
def brown_forsythe(spark, folder):
    return H.levene(load(spark, folder, "events"), "event_type", "value").drop("ss_between", "ss_within")


@query(
    "avg_rank",
    """
    SELECT l_orderkey, l_linenumber, l_quantity,
      rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::double AS rank FROM lineitem
    """,
    "rank",
)
def ranks(spark, folder):
    return avg_rank(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query(
    "avg_rank_by_group",
    """
    SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
      + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::double AS rank FROM events
    """,
    "rank",
)
def ranks_by_group(spark, folder):
    return avg_rank(load(spark, folder, "events"), "value", ["event_type"]).select("event_id", "rank")


@query(
    "mannwhitney",
    f"""
    WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::double AS r
      FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    s AS (SELECT count(*) FILTER (g = 'R') AS n1, count(*) FILTER (g = 'A') AS n0, sum(r) FILTER (g = 'R') AS sr FROM r),
    t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::double AS c FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_quantity)),
    u AS (SELECT n1, n0, sr - n1 * (n1 + 1) / 2.0::double AS u, ties,
      sqrt(n1 * n0 / 12.0::double * (n1 + n0 + 1 - ties / ((n1 + n0)::double * (n1 + n0 - 1)))) AS sd FROM s, t),
    z AS (SELECT *, (u - n1 * n0 / 2.0::double) / sd AS z FROM u)
    SELECT n1, n0, u, ties, sd, z, u / (n1::double * n0) AS prob_superior, {sql_p_norm('z')} AS p FROM z
    """,
    "u ties sd z prob_superior p",
    digits=5,
)
def mannwhitney(spark, folder):
    return H.mannwhitney(load(spark, folder, "lineitem"), "l_returnflag", "l_quantity", ("A", "R"))


@query(
    "wilcoxon_signed_rank",
    f"""
    WITH d AS (SELECT round(l_discount * 100) - round(l_tax * 100) - 1 AS d FROM lineitem),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::double AS r FROM d WHERE d <> 0),
    s AS (SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus FROM r),
    t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::double AS c FROM d WHERE d <> 0 GROUP BY abs(d))),
    z AS (SELECT *, (w_plus - n * (n + 1) / 4.0::double) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t)
    SELECT n, w_plus, w_minus, ties, z, {sql_p_norm('z')} AS p FROM z
    """,
    "w_plus w_minus ties z p",
    digits=5,
)
def wilcoxon(spark, folder):
    """Discount against tax plus one, in whole points."""
    rows = load(spark, folder, "lineitem").select(
        F.round(F.col("l_discount") * 100).alias("a"), (F.round(F.col("l_tax") * 100) + 1).alias("b")
    )
    return H.wilcoxon(rows, "a", "b")


@query(
    "ks_two_sample",
    """
    WITH v AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'A') AS a
      FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    f AS (SELECT sum(b) OVER (ORDER BY v) / sum(b) OVER ()::double AS f1, sum(a) OVER (ORDER BY v) / sum(a) OVER ()::double AS f0 FROM c)
    SELECT (SELECT sum(b)::bigint FROM c) AS n1, (SELECT sum(a)::bigint FROM c) AS n0, max(abs(f1 - f0)) AS d FROM f
    """,
    "d",
    digits=9,
)
def ks_2samp(spark, folder):
    return H.ks_2samp(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", ("A", "R")).drop("p")


@query(
    "ks_one_sample",
    f"""
    WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders),
    r AS (SELECT n, row_number() OVER (ORDER BY o_totalprice) AS i, (o_totalprice - m) / s AS z FROM orders, m),
    f AS (SELECT n, i, CASE WHEN z < 0 THEN {{p}} / 2 ELSE 1 - {{p}} / 2 END AS f FROM r)
    SELECT max(greatest(i / n::double - f, f - (i - 1) / n::double)) AS statistic FROM f
    """.replace("{p}", sql_p_norm("z").replace("2000", "200").replace("2001", "201").replace("6000", "600")),
    "statistic",
)
def ks_1samp(spark, folder):
    return H.ks_1samp(load(spark, folder, "orders"), "o_totalprice").select("statistic")


@query(
    "jarque_bera",
    f"""
    WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem),
    s AS (SELECT count(*) AS n, avg((l_quantity - m) ** 3) / pow(avg((l_quantity - m) ** 2), 1.5) AS skewness,
      avg((l_quantity - m) ** 4) / pow(avg((l_quantity - m) ** 2), 2) - 3 AS kurtosis FROM lineitem, m)
    SELECT n, skewness, kurtosis, n / 6.0::double * (skewness ** 2 + kurtosis ** 2 / 4) AS jb,
      exp(-n / 12.0::double * (skewness ** 2 + kurtosis ** 2 / 4)) AS p FROM s
    """,
    "skewness kurtosis jb p",
)
def jarque_bera(spark, folder):
    return H.jarque_bera(load(spark, folder, "lineitem"), "l_quantity")


CORR_TAIL = f"""
    SELECT n, r, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t, {sql_p_t('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p FROM c
"""


@query("corr_test", f"WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem) {CORR_TAIL}", "r t p")
def corr_test(spark, folder):
    return H.corr_test(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "corr_test_spearman",
    f"""
    WITH k AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS a,
      rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::double AS b FROM orders),
    c AS (SELECT count(*) AS n, corr(a, b) AS r FROM k) {CORR_TAIL}
    """,
    "r t p",
)
def corr_test_spearman(spark, folder):
    return H.corr_test(load(spark, folder, "orders"), "o_totalprice", "o_custkey", "spearman")
