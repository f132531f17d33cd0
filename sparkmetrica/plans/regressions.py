"""Price-factor regressions and endogeneity queries.

The test tables hold no effects, so two data sets are derived from every row of
``lineitem``: home prices with known factors and unequal noise, and a regressor
that depends on a hidden term. Noise comes from hashes of the row's keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform
from sparkmetrica.operators import iv as V
from sparkmetrica.operators import regression as R
from sparkmetrica.operators.moments import moments
from sparkmetrica.plans.registry import query, sql_p_chi2, sql_p_f, sql_uniform
from sparkmetrica.sources.tables import load

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_KEY_SQL = "l_orderkey || ':' || l_linenumber || ':' || l_partkey"

HOMES_SQL = f"""
    SELECT l_orderkey, l_linenumber, l_suppkey, l_linestatus, l_returnflag, (20 + 2 * l_quantity) AS area, dist, ln(20 + 2 * l_quantity) AS ln_area,
      8 + 0.9 * ln(20 + 2 * l_quantity) - 0.04 * dist + 0.01 * (l_suppkey % 7)
        + 0.02 * (h1 + h2 - 1) * sqrt(20 + 2 * l_quantity) AS ln_price
    FROM (SELECT *, 1 + 14 * {sql_uniform(_KEY_SQL, 'home')} AS dist, {sql_uniform(_KEY_SQL, 'home', 1)} AS h1, {sql_uniform(_KEY_SQL, 'home', 2)} AS h2 FROM lineitem)
"""


def homes(spark, folder):
    """ln(price) = 8 + 0.9 ln(area) - 0.04 distance + supplier effect + noise that grows with area."""
    area = 20 + 2 * F.col("l_quantity")
    dist = 1 + 14 * hash_uniform(ROW_KEY, "home")
    noise = F.lit(0.02) * (hash_uniform(ROW_KEY, "home", 1) + hash_uniform(ROW_KEY, "home", 2) - 1)
    rows = load(spark, folder, "lineitem").withColumns({"area": area, "dist": dist, "ln_area": F.ln(area), "_noise": noise})
    price = 8 + F.lit(0.9) * F.col("ln_area") - F.lit(0.04) * F.col("dist") + F.lit(0.01) * (F.col("l_suppkey") % 7)
    return rows.withColumn("ln_price", price + F.col("_noise") * F.sqrt("area")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "area", "dist", "ln_area", "ln_price"
    )


Y, X1, X2 = "ln_price", "ln_area", "dist"
X = [X1, X2]


def fit2_sql(rows: str, y: str = Y, x1: str = X1, x2: str = X2) -> str:
    """Textbook two-regressor least squares: tables r (rows), c (sums), b (fit), e (rows with residuals)."""
    def s(a, b):
        return f"covar_pop({a}, {b}) * count(*)"

    return f"""
    WITH r AS ({rows}),
    c AS (SELECT count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, {s(x1, x1)} AS c11, {s(x1, x2)} AS c12, {s(x2, x2)} AS c22,
      {s(x1, y)} AS c1y, {s(x2, y)} AS c2y, {s(y, y)} AS cyy FROM r),
    i AS (SELECT *, c22 / (c11 * c22 - c12 ** 2) AS i11, c11 / (c11 * c22 - c12 ** 2) AS i22, -c12 / (c11 * c22 - c12 ** 2) AS i12 FROM c),
    b AS (SELECT *, i11 * c1y + i12 * c2y AS b1, i12 * c1y + i22 * c2y AS b2,
      my - m1 * (i11 * c1y + i12 * c2y) - m2 * (i12 * c1y + i22 * c2y) AS b0 FROM i),
    e AS (SELECT r.*, b.*, {y} - b0 - b1 * {x1} - b2 * {x2} AS e, i11 * ({x1} - m1) + i12 * ({x2} - m2) AS r1, i12 * ({x1} - m1) + i22 * ({x2} - m2) AS r2,
      1.0::double / n + i11 * ({x1} - m1) ** 2 + 2 * i12 * ({x1} - m1) * ({x2} - m2) + i22 * ({x2} - m2) ** 2 AS h FROM r, b),
    q AS (SELECT any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(cyy) AS tss, sum(e * e) AS rss,
      sum(e * e) / (any_value(n) - 3) AS s2, any_value(i11) AS i11, any_value(i22) AS i22, any_value(i12) AS i12,
      any_value(m1) AS m1, any_value(m2) AS m2, any_value(c11) AS c11, any_value(c22) AS c22, any_value(c12) AS c12,
      any_value(c1y) AS c1y, any_value(c2y) AS c2y FROM e)
    """


def table_sql(se: str, source: str = "q") -> str:
    """Coefficient rows from columns b0..b2 and the standard errors in ``se``."""
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS term, b{j} AS coef, {se.replace('#', str(j))} AS se, n FROM {source}"
        for j, t in enumerate(("const", X1, X2))
    )
    return f"SELECT term, coef, se, coef / se AS t FROM ({rows})"


CLASSICAL = """, v AS (SELECT *, sqrt(s2 * (1.0::double / n + i11 * m1 ** 2 + 2 * i12 * m1 * m2 + i22 * m2 ** 2)) AS se0, sqrt(s2 * i11) AS se1, sqrt(s2 * i22) AS se2 FROM q) """


@query(
    "design_matrix",
    """
    SELECT p_partkey, ln(p_retailprice) AS y, p_size::double AS p_size, ln(p_size) AS ln_p_size, pow(p_size, 2) AS p_size_2, p_size * p_retailprice AS p_size_x_p_retailprice,
    """
    + ", ".join(f"(p_type = '{t}')::int::double AS \"p_type={t}\"" for t in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM part",
    "y ln_p_size p_size_2 p_size_x_p_retailprice",
    digits=5,
)
def design_matrix(spark, folder):
    terms = ["p_size", ("log", "p_size"), ("pow", "p_size", 2), ("inter", "p_size", "p_retailprice"), ("dummy", "p_type", "ECONOMY")]
    rows, names = R.design(load(spark, folder, "part"), ("log", "p_retailprice"), terms)
    return rows.withColumn("p_size", F.col("p_size").cast("double")).select("p_partkey", "y", *names)


@query(
    "moment_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, avg({a}) AS mean_a, covar_pop({a}, {b}) AS cov FROM ({HOMES_SQL})"
        for a in (Y, X1, X2) for b in (Y, X1, X2)
    ),
    "mean_a cov",
    digits=9,
)
def moment_matrix(spark, folder):
    m = moments(homes(spark, folder), [Y, X1, X2])
    rows = [(a, b, m.n, float(m.mean[i]), float(m.s[i, j] / m.n)) for i, a in enumerate(m.names) for j, b in enumerate(m.names)]
    return spark.createDataFrame(rows, "a string, b string, n bigint, mean_a double, cov double")


@query(
    "ols",
    f"{fit2_sql(HOMES_SQL)} {CLASSICAL} {table_sql('se#', 'v')}",
    "coef se t",
)
def ols(spark, folder):
    """The p column is not compared: all the factors are far from zero."""
    return R.ols(homes(spark, folder), Y, X).table(spark).drop("p", "ci_lo", "ci_hi")


@query(
    "ols_summary",
    f"""{fit2_sql(HOMES_SQL)} SELECT n, 0::bigint AS n_dropped, 2::bigint AS k, n - 3 AS df_resid, 1 - rss / tss AS r2,
    1 - (rss / (n - 3)) / (tss / (n - 1)) AS adj_r2, sqrt(s2) AS sigma, ((tss - rss) / 2) / s2 / n AS f_per_row,
    (n * (ln(2 * pi() * rss / n) + 1) + 6) / n AS aic_per_row, (n * (ln(2 * pi() * rss / n) + 1) + 3 * ln(n)) / n AS bic_per_row FROM q""",
    "r2 adj_r2 sigma f_per_row aic_per_row bic_per_row",
)
def ols_summary(spark, folder):
    got = R.ols(homes(spark, folder), Y, X).summary(spark)
    per_row = {f"{c}_per_row": F.col(c) / F.col("n") for c in ("f", "aic", "bic")}
    return got.withColumns(per_row).drop("f", "f_p", "aic", "bic")


@query(
    "wls",
    f"""
    WITH r AS ({HOMES_SQL}), m AS (SELECT sum(1 / area) AS w, sum(ln_area / area) / sum(1 / area) AS mx, sum(ln_price / area) / sum(1 / area) AS my FROM r),
    b AS (SELECT *, (SELECT sum((ln_area - mx) * (ln_price - my) / area) / sum((ln_area - mx) ** 2 / area) FROM r, m) AS b1 FROM m),
    s AS (SELECT count(*) AS n, any_value(b1) AS b1, any_value(my - b1 * mx) AS b0, any_value(mx) AS mx, any_value(w) AS w,
      sum((ln_area - mx) ** 2 / area) AS sxx, sum((ln_price - my - b1 * (ln_area - mx)) ** 2 / area) / (count(*) - 2) AS s2 FROM r, b)
    SELECT 'const' AS term, b0 AS coef, sqrt(s2 * (1 / w + mx ** 2 / sxx)) AS se FROM s
    UNION ALL SELECT 'ln_area', b1, sqrt(s2 / sxx) FROM s
    """,
    "coef se",
)
def wls(spark, folder):
    """Rows weighted by 1 / area."""
    rows = homes(spark, folder).withColumn("weight", 1 / F.col("area"))
    return R.wls(rows, Y, [X1], "weight").table(spark).select("term", "coef", "se")


WEIGHTED_SQL = f"""
    WITH r AS ({HOMES_SQL}), m AS (SELECT sum(1 / area) AS w, sum(ln_area / area) / sum(1 / area) AS mx, sum(ln_price / area) / sum(1 / area) AS my FROM r),
    b AS (SELECT *, (SELECT sum((ln_area - mx) * (ln_price - my) / area) / sum((ln_area - mx) ** 2 / area) FROM r, m) AS b1 FROM m),
    s AS (SELECT count(*) AS n, any_value(b1) AS b1, any_value(my - b1 * mx) AS b0, any_value(mx) AS mx, any_value(w) AS w, sum(ln(1 / area)) AS logs,
      sum((ln_area - mx) ** 2 / area) AS sxx, sum((ln_price - my) ** 2 / area) AS tss, sum((ln_price - my - b1 * (ln_area - mx)) ** 2 / area) AS rss FROM r, b),
    e AS (SELECT r.*, s.*, ln_price - b0 - b1 * ln_area AS e, (1 / w + (ln_area - mx) ** 2 / sxx) AS q FROM r, s)
"""


def weighted(spark, folder):
    rows = homes(spark, folder).withColumn("weight", 1 / F.col("area"))
    return rows, R.wls(rows, Y, [X1], "weight")


@query(
    "wls_summary",
    WEIGHTED_SQL + """SELECT n, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / (n - 2) AS adj_r2, sqrt(rss / (n - 2)) AS sigma,
      (n * (ln(2 * pi() * rss / n) + 1) - logs + 4) / n AS aic_per_row, (n * (ln(2 * pi() * rss / n) + 1) - logs + 2 * ln(n)) / n AS bic_per_row FROM s""",
    "r2 adj_r2 sigma aic_per_row bic_per_row",
)
def wls_summary(spark, folder):
    """Likelihood of normal errors of variance s2 / w."""
    got = weighted(spark, folder)[1].summary(spark)
    per_row = [(F.col(c) / F.col("n")).alias(f"{c}_per_row") for c in ("aic", "bic")]
    return got.select("n", "r2", "adj_r2", "sigma", *per_row)


@query(
    "wls_predict",
    WEIGHTED_SQL + """SELECT l_orderkey, l_linenumber, ln_price - e AS predicted, ((pred_hi - (ln_price - e)) / sqrt(rss / (n - 2) * (area + q))) AS quantile, pred_lo + pred_hi - 2 * (ln_price - e) AS lopsided
      FROM (SELECT *, ln_price - e + t * sqrt(rss / (n - 2) * (area + q)) AS pred_hi, ln_price - e - t * sqrt(rss / (n - 2) * (area + q)) AS pred_lo
        FROM e, (SELECT z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) AS t FROM (SELECT 1.959963984540054::double AS z, (n - 2)::double AS df FROM s)))""",
    "predicted quantile lopsided",
    digits=5,
)
def wls_predict(spark, folder):
    """Intervals of new observations: half-widths in units of their standard error, s2 (1 / w + x'Ax), are the t quantile."""
    rows, fit = weighted(spark, folder)
    c = F.col(X1) - F.lit(float(fit.m.means([X1])[0]))
    error = F.sqrt(F.lit(fit.rss / fit.df_resid) * (F.col("area") + F.lit(1.0 / fit.m.weight) + c * c * F.lit(float(fit.inverse[0, 0]))))
    got = R.predict(fit, rows)
    return got.select("l_orderkey", "l_linenumber", "predicted", ((F.col("pred_hi") - F.col("predicted")) / error).alias("quantile"), (F.col("pred_lo") + F.col("pred_hi") - 2 * F.col("predicted")).alias("lopsided"))


@query(
    "wls_influence",
    WEIGHTED_SQL + """SELECT l_orderkey, l_linenumber, e AS residual, n * q / area AS leverage_n, e / sqrt(area) / sqrt(rss / (n - 2) * (1 - q / area)) AS student,
      n * (e ** 2 / area) / (2 * rss / (n - 2)) * (q / area) / (1 - q / area) ** 2 AS cooks_n FROM e""",
    "residual leverage_n student cooks_n",
    digits=4,
)
def wls_influence(spark, folder):
    rows, fit = weighted(spark, folder)
    scaled = [(F.col("leverage") * fit.n).alias("leverage_n"), (F.col("cooks_d") * fit.n).alias("cooks_n")]
    return R.influence(fit, rows).select("l_orderkey", "l_linenumber", "residual", "student", *scaled)


def _robust_sql(factor: str, scale: str = "1") -> str:
    sums = ", ".join(
        f"sqrt({scale} * sum(({r} * e) ** 2 * {factor})) AS se{j}"
        for j, r in enumerate(("(1.0::double / n - m1 * r1 - m2 * r2)", "r1", "r2"))
    )
    return f"{fit2_sql(HOMES_SQL)}, v AS (SELECT any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {sums} FROM e) {table_sql('se#', 'v')}"


def _robust(kind):
    def run(spark, folder):
        rows = homes(spark, folder)
        return R.robust_cov(R.ols(rows, Y, X), rows, kind).table(spark).drop("p", "ci_lo", "ci_hi")

    return run


for _kind, _factor, _scale in (
    ("HC0", "1", "1"), ("HC1", "1", "any_value(n) / (any_value(n) - 3)"), ("HC2", "1 / (1 - h)", "1"), ("HC3", "1 / (1 - h) ** 2", "1"),
):
    query(f"robust_{_kind.lower()}", _robust_sql(_factor, _scale), "coef se t")(_robust(_kind))


@query(
    "cluster_robust",
    f"""{fit2_sql(HOMES_SQL)},
    g AS (SELECT l_suppkey, any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
      sum((1.0::double / n - m1 * r1 - m2 * r2) * e) AS g0, sum(r1 * e) AS g1, sum(r2 * e) AS g2 FROM e GROUP BY 1),
    v AS (SELECT any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
      sqrt(sum(g0 ** 2) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 3)) AS se0,
      sqrt(sum(g1 ** 2) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 3)) AS se1,
      sqrt(sum(g2 ** 2) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 3)) AS se2 FROM g)
    {table_sql('se#', 'v')}""",
    "coef se t",
)
def cluster_robust(spark, folder):
    rows = homes(spark, folder)
    return R.cluster_cov(R.ols(rows, Y, X), rows, "l_suppkey").table(spark).drop("p", "ci_lo", "ci_hi")


@query(
    "cluster_robust_null_cluster",
    f"""{fit2_sql(HOMES_SQL)},
    g AS (SELECT nullif(l_suppkey % 10, 3) AS c, any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
      sum((1.0::double / n - m1 * r1 - m2 * r2) * e) AS g0, sum(r1 * e) AS g1, sum(r2 * e) AS g2 FROM e GROUP BY 1),
    v AS (SELECT any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sqrt(sum(g0 ** 2)) AS se0, sqrt(sum(g1 ** 2)) AS se1, sqrt(sum(g2 ** 2)) AS se2 FROM g)
    {table_sql('se#', 'v')}""",
    "coef se t",
)
def cluster_robust_null_cluster(spark, folder):
    """Rows without a cluster count as a cluster of their own."""
    rows = homes(spark, folder).withColumn("cluster", F.nullif(F.col("l_suppkey") % 10, F.lit(3)))
    return R.cluster_cov(R.ols(rows, Y, X), rows, "cluster", "CR0").table(spark).drop("p", "ci_lo", "ci_hi")


@query(
    "wald",
    f"""{fit2_sql(HOMES_SQL)}, f AS (SELECT (b1 + 20 * b2 - 0.1) ** 2 / (s2 * (i11 + 40 * i12 + 400 * i22)) AS f, 1::bigint AS df1, n - 3 AS df2 FROM q)
    SELECT f, df1, df2, {sql_p_f('f', 'df1', 'df2')} AS p FROM f""",
    "f p",
    digits=5,
)
def wald(spark, folder):
    """Is the area elasticity 0.1 more than 20 times the distance effect? (planted: it is)"""
    return R.as_table(spark, R.wald(R.ols(homes(spark, folder), Y, X), [0, 1, 20], [0.1]))


@query(
    "chow",
    f"""
    WITH r AS ({HOMES_SQL}),
    p AS (SELECT count(*) AS n, regr_syy(ln_price, ln_area) - regr_sxy(ln_price, ln_area) ** 2 / regr_sxx(ln_price, ln_area) AS rss FROM r),
    g AS (SELECT regr_syy(ln_price, ln_area) - regr_sxy(ln_price, ln_area) ** 2 / regr_sxx(ln_price, ln_area) AS rss FROM r GROUP BY l_returnflag),
    s AS (SELECT count(*) AS groups, sum(rss) AS rss FROM g),
    f AS (SELECT ((p.rss - s.rss) / ((groups - 1) * 2)) / (s.rss / (n - groups * 2)) AS f, (groups - 1) * 2 AS df1, n - groups * 2 AS df2, groups FROM p, s)
    SELECT f, df1, df2, {sql_p_f('f', 'df1', 'df2')} AS p, groups FROM f
    """,
    "f p",
    digits=5,
)
def chow(spark, folder):
    return R.as_table(spark, R.chow(homes(spark, folder), Y, [X1], "l_returnflag"))


@query(
    "vif",
    f"{fit2_sql(HOMES_SQL)} SELECT unnest(['ln_area', 'dist']) AS term, 1 / (1 - c12 ** 2 / (c11 * c22)) AS vif FROM q",
    "vif",
    digits=9,
)
def vif(spark, folder):
    return R.vif(R.ols(homes(spark, folder), Y, X), spark).select("term", "vif")


def _auxiliary_sql(rows: str, x1: str, x2: str) -> str:
    """LM and F of squared residuals on two regressors."""
    return f"""{fit2_sql(rows, 'e2', x1, x2)},
    t AS (SELECT n * (1 - rss / tss) AS lm, 2::bigint AS df, ((tss - rss) / 2) / s2 AS f, n FROM q)
    SELECT lm, df, f, {sql_p_chi2('lm', 'df')} AS p FROM t"""


BP_ROWS = f"SELECT ln_area, dist, e * e AS e2 FROM ({fit2_sql(HOMES_SQL)} SELECT ln_area, dist, e FROM e)"
# one regressor for White's test: its square is the only extra term
WHITE_ROWS = f"""
    WITH r1 AS ({HOMES_SQL}), f1 AS (SELECT regr_slope(ln_price, dist) AS s, regr_intercept(ln_price, dist) AS a, avg(dist) AS md FROM r1)
    SELECT dist - md AS x1, (dist - md) ** 2 AS x2, (ln_price - a - s * dist) ** 2 AS e2 FROM r1, f1
"""


@query("breusch_pagan", _auxiliary_sql(BP_ROWS, "ln_area", "dist"), "lm f p", 4)
def breusch_pagan(spark, folder):
    rows = homes(spark, folder)
    return R.as_table(spark, R.bp_test(R.ols(rows, Y, X), rows)).drop("f_p")


@query("white", _auxiliary_sql(WHITE_ROWS, "x1", "x2"), "lm f p", 4)
def white(spark, folder):
    rows = homes(spark, folder)
    return R.as_table(spark, R.white_test(R.ols(rows, Y, [X2]), rows)).drop("f_p")


@query(
    "reset",
    f"""{fit2_sql(f'SELECT ln_price, ln_area, ln_area ** 2 AS x2 FROM ({HOMES_SQL})', x2='x2')},
    t AS (SELECT ((cyy - c1y ** 2 / c11) - rss) / s2 AS f, 1::bigint AS df1, q.n - 3 AS df2 FROM q, (SELECT cyy FROM c))
    SELECT f, df1, df2, {sql_p_f('f', 'df1', 'df2')} AS p FROM t""",
    "f p",
    digits=4,
)
def reset(spark, folder):
    """With one regressor the squared fit adds what the squared regressor adds."""
    rows = homes(spark, folder)
    return R.as_table(spark, R.reset_test(R.ols(rows, Y, [X1]), rows, (2,)))


@query(
    "residual_normality",
    f"""{fit2_sql(HOMES_SQL)}, s AS (SELECT count(*) AS n, avg(e ** 3) / pow(avg(e ** 2), 1.5) AS skewness, avg(e ** 4) / pow(avg(e ** 2), 2) - 3 AS kurtosis FROM e)
    SELECT n, skewness, kurtosis, n / 6.0::double * (skewness ** 2 + kurtosis ** 2 / 4) AS jb FROM s""",
    "skewness kurtosis jb",
    digits=5,
)
def residual_normality(spark, folder):
    rows = homes(spark, folder)
    return R.residual_normality(R.ols(rows, Y, X), rows).drop("p")


@query(
    "influence",
    f"""{fit2_sql(HOMES_SQL)}, t AS (SELECT e.*, s2, rss FROM e, q)
    SELECT l_orderkey, l_linenumber, ln_price - e AS fitted, e AS residual, n * h AS leverage_n, e / sqrt(s2 * (1 - h)) AS student,
      e / sqrt((rss - e * e / (1 - h)) / (n - 4) * (1 - h)) AS student_ext, n * e * e / (3 * s2) * h / (1 - h) ** 2 AS cooks_n FROM t""",
    "fitted residual leverage_n student student_ext cooks_n",
    digits=4,
)
def influence(spark, folder):
    rows = homes(spark, folder)
    fit = R.ols(rows, Y, X)
    scaled = [(F.col("leverage") * fit.n).alias("leverage_n"), (F.col("cooks_d") * fit.n).alias("cooks_n")]
    got = R.influence(fit, rows)
    return got.select("l_orderkey", "l_linenumber", "fitted", "residual", "student", "student_ext", *scaled)


def _model_sql(name: str, k: int, rss: str) -> str:
    return f"""SELECT '{name}' AS model, {k}::bigint AS k, n, 1 - {rss} / tss AS r2, sqrt({rss} / (n - {k + 1})) AS sigma,
    (n * (ln(2 * pi() * {rss} / n) + 1) + 2 * {k + 1}) / n AS aic_per_row FROM q"""


@query(
    "compare_models",
    f"{fit2_sql(HOMES_SQL)} {_model_sql('area', 1, '(tss - c1y ** 2 / c11)')} UNION ALL {_model_sql('dist', 1, '(tss - c2y ** 2 / c22)')} UNION ALL {_model_sql('both', 2, 'rss')}",
    "r2 sigma aic_per_row",
)
def compare_models(spark, folder):
    got = R.compare(homes(spark, folder), Y, {"area": [X1], "dist": [X2], "both": X})
    return got.select("model", "k", "n", "r2", "sigma", (F.col("aic") / F.col("n")).alias("aic_per_row"))


@query("stepwise")
def stepwise(spark, folder):
    """Forward selection by BIC over factors and two columns that have no effect."""
    rows = homes(spark, folder).withColumns({"supplier": F.col("l_suppkey") % 7, "noise": hash_uniform(ROW_KEY, "nothing")})
    _, path = R.stepwise(rows, Y, [X1, X2, "supplier", "noise", "l_linenumber"], "bic")
    return spark.createDataFrame([(i, c, float(v)) for i, (c, v) in enumerate(path)], "step int, added string, bic double")


@query(
    "ols_by_group",
    f"""
    WITH r AS ({HOMES_SQL}),
    g AS (SELECT l_suppkey, count(*) AS n, regr_slope(ln_price, ln_area) AS b1, regr_intercept(ln_price, ln_area) AS b0, regr_r2(ln_price, ln_area) AS r2,
      regr_sxx(ln_price, ln_area) AS sxx, avg(ln_area) AS m, (regr_syy(ln_price, ln_area) - regr_sxy(ln_price, ln_area) ** 2 / regr_sxx(ln_price, ln_area)) AS rss FROM r GROUP BY 1)
    SELECT l_suppkey, 'ln_area' AS term, b1 AS coef, sqrt(rss / (n - 2) / sxx) AS se, n, r2 FROM g
    UNION ALL SELECT l_suppkey, 'const', b0, sqrt(rss / (n - 2) * (1.0::double / n + m ** 2 / sxx)), n, r2 FROM g
    """,
    "coef se r2",
)
def ols_by_group(spark, folder):
    return R.ols_by(homes(spark, folder), ["l_suppkey"], Y, [X1]).select("l_suppkey", "term", "coef", "se", "n", "r2")


@query(
    "ols_by_small_groups",
    f"""
    WITH r AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE ln_area END AS x FROM ({HOMES_SQL})),
    g AS (SELECT l_orderkey, count(x) AS n, regr_slope(ln_price, x) AS b1, regr_intercept(ln_price, x) AS b0, regr_sxx(ln_price, x) AS sxx FROM r GROUP BY 1)
    SELECT l_orderkey, term, n, CASE WHEN n <= 2 THEN 'too few rows' WHEN sxx <= 1e-10 * n THEN 'constant or collinear' END AS reason,
      CASE WHEN n > 2 AND sxx > 1e-10 * n THEN CASE term WHEN 'const' THEN b0 ELSE b1 END END AS coef
    FROM g, (SELECT unnest(['const', 'x']) AS term)
    """,
    "coef",
    digits=4,
)
def ols_by_small_groups(spark, folder):
    """A regression per order: most have too few rows, some no complete row, and all are reported."""
    rows = homes(spark, folder).withColumn("x", F.when(F.col("l_orderkey") % 3 != 0, F.col("ln_area")))
    return R.ols_by(rows, ["l_orderkey"], Y, ["x"]).select("l_orderkey", "term", "n", "reason", "coef")


@query(
    "fixed_effects",
    f"""
    WITH d AS (SELECT l_suppkey, ln_price - avg(ln_price) OVER w AS y, ln_area - avg(ln_area) OVER w AS x FROM ({HOMES_SQL}) WINDOW w AS (PARTITION BY l_suppkey)),
    b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) - count(DISTINCT l_suppkey) - 1 AS df FROM d)
    SELECT 'ln_area' AS term, any_value(b) AS coef, sqrt(sum((y - b * x) ** 2) / any_value(df) / any_value(sxx)) AS se, any_value(df) AS df_resid FROM d, b
    """,
    "coef se",
)
def fixed_effects(spark, folder):
    fit = R.within(homes(spark, folder), "l_suppkey", Y, [X1])
    return fit.table(spark).where("term = 'ln_area'").select("term", "coef", "se", F.lit(fit.df_resid).cast("bigint").alias("df_resid"))


@query(
    "glm_logit",
    """
    WITH c AS (SELECT count(*) FILTER (x AND y)::double AS a, count(*) FILTER (x AND NOT y)::double AS b, count(*) FILTER (NOT x AND y)::double AS c,
      count(*) FILTER (NOT x AND NOT y)::double AS d FROM (SELECT l_linestatus = 'O' AS x, l_returnflag = 'R' AS y FROM lineitem))
    SELECT 'const' AS term, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM c UNION ALL SELECT 'open', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM c
    """,
    "coef se",
)
def glm_logit(spark, folder):
    """One binary regressor: the estimates are log odds, known in closed form."""
    rows = load(spark, folder, "lineitem").withColumns({"open": (F.col("l_linestatus") == "O").cast("double"), "returned": (F.col("l_returnflag") == "R").cast("double")})
    return R.glm(rows, "returned", ["open"], "binomial").select("term", "coef", "se")


@query(
    "glm_poisson",
    """
    WITH c AS (SELECT sum(l_linenumber) FILTER (l_linestatus = 'O')::double AS s1, count(*) FILTER (l_linestatus = 'O') AS n1,
      sum(l_linenumber) FILTER (l_linestatus = 'F')::double AS s0, count(*) FILTER (l_linestatus = 'F') AS n0 FROM lineitem)
    SELECT 'const' AS term, ln(s0 / n0) AS coef, sqrt(1 / s0) AS se FROM c UNION ALL SELECT 'open', ln(s1 / n1) - ln(s0 / n0), sqrt(1 / s0 + 1 / s1) FROM c
    """,
    "coef se",
)
def glm_poisson(spark, folder):
    rows = load(spark, folder, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("double"))
    return R.glm(rows, "l_linenumber", ["open"], "poisson").select("term", "coef", "se")


@query(
    "glm_gamma",
    """
    WITH c AS (SELECT avg(l_quantity) FILTER (l_linestatus = 'O') AS m1, avg(l_quantity) FILTER (l_linestatus = 'F') AS m0 FROM lineitem)
    SELECT 'const' AS term, ln(m0) AS coef FROM c UNION ALL SELECT 'open', ln(m1) - ln(m0) FROM c
    """,
    "coef",
)
def glm_gamma(spark, folder):
    rows = load(spark, folder, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("double"))
    return R.glm(rows, "l_quantity", ["open"], "gamma").select("term", "coef")


def _penalty_sql(slope: str) -> str:
    return f"""
    WITH s AS (SELECT avg(ln_area) AS mx, avg(ln_price) AS my, corr(ln_price, ln_area) AS r, stddev_pop(ln_price) AS sy, stddev_pop(ln_area) AS sx FROM ({HOMES_SQL})),
    b AS (SELECT *, {slope} * sy / sx AS b FROM s)
    SELECT 'const' AS term, my - b * mx AS coef FROM b UNION ALL SELECT 'ln_area', b FROM b
    """


@query("ridge", _penalty_sql("r / (1 + 0.05 / sy)"), "coef", 5)
def ridge(spark, folder):
    return R.penalized(homes(spark, folder), Y, [X1], 0.05).select("term", "coef")


@query("lasso", _penalty_sql("(r - 0.05 / sy)"), "coef", 5)
def lasso(spark, folder):
    return R.penalized(homes(spark, folder), Y, [X1], 0.05, 1.0).select("term", "coef")


@query("elastic_net", _penalty_sql("(r - 0.5 * 0.05 / sy) / (1 + 0.5 * 0.05 / sy)"), "coef", 5)
def elastic_net(spark, folder):
    """One regressor: the soft threshold and the shrinkage have a closed form."""
    return R.penalized(homes(spark, folder), Y, [X1], 0.05, 0.5).select("term", "coef")


@query(
    "predict",
    f"{fit2_sql(HOMES_SQL)} SELECT l_orderkey, l_linenumber, ln_price - e AS predicted FROM e",
    "predicted",
    digits=4,
)
def predict(spark, folder):
    rows = homes(spark, folder)
    return R.predict(R.ols(rows, Y, X), rows).select("l_orderkey", "l_linenumber", "predicted")


@query(
    "prediction_errors",
    f"{fit2_sql(HOMES_SQL)} SELECT count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / ln_price)) AS mape, 1 - sum(e * e) / any_value(cyy) AS r2 FROM e",
    "rmse mae mape r2",
)
def prediction_errors(spark, folder):
    rows = homes(spark, folder)
    return R.errors(R.predict(R.ols(rows, Y, X), rows), Y, "predicted")


@query(
    "factor_effects",
    f"""{fit2_sql(HOMES_SQL)} SELECT 'ln_area' AS term, b1 AS coef, 100 * (exp(b1) - 1) AS percent_effect, b1 * sqrt(c11 / tss) AS beta_std, b1 * c1y / tss AS contribution FROM q
    UNION ALL SELECT 'dist', b2, 100 * (exp(b2) - 1), b2 * sqrt(c22 / tss), b2 * c2y / tss FROM q""",
    "coef percent_effect beta_std contribution",
)
def factor_effects(spark, folder):
    return R.factor_effects(R.ols(homes(spark, folder), Y, X), spark)


# source term, hash seed and part of the hash
HIDDEN = [("z1", "iv", 0), ("z2", "iv", 1), ("w", "iv", 2), ("u", "iv", 3), ("e1", "noise", 0), ("e2", "noise", 1)]
HIDDEN_SQL = f"""
    SELECT z1, z2, w, z1 + 0.5 * z2 + 0.8 * u + e1 AS x, 1 + 2 * (z1 + 0.5 * z2 + 0.8 * u + e1) + 0.3 * w + u + e2 AS y, l_suppkey FROM (SELECT l_suppkey,
    """ + ", ".join(f"{sql_uniform(_KEY_SQL, s, i)} - 0.5 AS {c}" for c, s, i in HIDDEN) + " FROM lineitem)"


def hidden(spark, folder):
    """x depends on the hidden u, and so does y: the slope 2 is biased in least squares."""
    rows = load(spark, folder, "lineitem").select(
        "l_suppkey", *[(hash_uniform(ROW_KEY, s, i) - 0.5).alias(c) for c, s, i in HIDDEN]
    )
    rows = rows.withColumn("x", F.col("z1") + 0.5 * F.col("z2") + 0.8 * F.col("u") + F.col("e1"))
    y = 1 + 2 * F.col("x") + 0.3 * F.col("w") + F.col("u") + F.col("e2")
    return rows.withColumn("y", y).select("z1", "z2", "w", "x", "y", "l_suppkey")


def _iv_sql() -> str:
    """2SLS of y on x and w with two instruments, w partialled out of everything."""
    names = ("y", "x", "z1", "z2")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s_{a}_{b}" for a, b in pairs)
    ws = ", ".join(f"covar_pop({a}, w) * count(*) AS w_{a}" for a in names)
    parts = ", ".join(f"s_{a}_{b} - w_{a} * w_{b} / ww AS {a}_{b}" for a, b in pairs)
    means = ", ".join(f"avg({a}) AS m_{a}" for a in (*names, "w"))
    return f"""
    WITH r AS ({HIDDEN_SQL}),
    m AS (SELECT count(*) AS n, {sums}, {ws}, covar_pop(w, w) * count(*) AS ww, {means} FROM r),
    p AS (SELECT n, ww, w_x, w_y, w_z1, w_z2, m_y, m_x, m_w, m_z1, m_z2, {parts} FROM m),
    i AS (SELECT *, z2_z2 / (z1_z1 * z2_z2 - z1_z2 ** 2) AS j11, z1_z1 / (z1_z1 * z2_z2 - z1_z2 ** 2) AS j22, -z1_z2 / (z1_z1 * z2_z2 - z1_z2 ** 2) AS j12 FROM p),
    f AS (SELECT *, j11 * x_z1 + j12 * x_z2 AS p1, j12 * x_z1 + j22 * x_z2 AS p2 FROM i),
    a AS (SELECT *, p1 * x_z1 + p2 * x_z2 AS a, p1 * y_z1 + p2 * y_z2 AS hy FROM f),
    b AS (SELECT *, hy / a AS b FROM a),
    s AS (SELECT *, y_y - 2 * b * y_x + b * b * x_x AS rss, (w_y - b * w_x) / ww AS bw FROM b)
    """


@query("iv_2sls", _iv_sql() + """SELECT 'x' AS term, b AS coef, sqrt(rss / (n - 3) / a) AS se FROM s
    UNION ALL SELECT 'w', bw, NULL FROM s UNION ALL SELECT 'const', m_y - b * m_x - bw * m_w, NULL FROM s""", "coef se")
def iv_2sls(spark, folder):
    fit = V.iv2sls(V.iv_model(hidden(spark, folder), "y", ["w"], ["x"], ["z1", "z2"]))
    return fit.table(spark).select("term", "coef", F.when(F.col("term") == "x", F.col("se")).alias("se"))


@query(
    "iv_one_instrument",
    f"""
    WITH r AS ({HIDDEN_SQL}), b AS (SELECT covar_pop(z1, y) / covar_pop(z1, x) AS b, avg(y) AS my, avg(x) AS mx FROM r),
    e AS (SELECT any_value(b) AS b, sum((y - my - b * (x - mx)) ** 2) / (count(*) - 2) AS s2, any_value(my - b * mx) AS b0 FROM r, b)
    SELECT 'x' AS term, b AS coef, (SELECT sqrt(s2 * var_pop(z1) * count(*)) / abs(covar_pop(z1, x) * count(*)) FROM r) AS se FROM e
    UNION ALL SELECT 'const', b0, NULL FROM e
    """,
    "coef se",
)
def iv_one_instrument(spark, folder):
    fit = V.iv2sls(V.iv_model(hidden(spark, folder), "y", [], ["x"], ["z1"]))
    return fit.table(spark).select("term", "coef", F.when(F.col("term") == "x", F.col("se")).alias("se"))


@query("iv_bias", _iv_sql() + "SELECT y_x / x_x AS ols, b AS iv FROM s", "ols iv")
def iv_bias(spark, folder):
    model = V.iv_model(hidden(spark, folder), "y", ["w"], ["x"], ["z1", "z2"])
    slopes = [float(f.slopes[f.x.index("x")]) for f in (V.ols_counterpart(model), V.iv2sls(model))]
    return spark.createDataFrame([tuple(slopes)], "ols double, iv double")


@query("iv_first_stage", _iv_sql() + """SELECT 'x' AS endog, (a / 2) / ((x_x - a) / (n - 4)) AS f, 2::bigint AS df1, n - 4 AS df2, a / x_x AS partial_r2 FROM s""", "f partial_r2", 4)
def iv_first_stage(spark, folder):
    return V.first_stage(V.iv_model(hidden(spark, folder), "y", ["w"], ["x"], ["z1", "z2"]), spark).drop("p")


@query("iv_endogeneity", _iv_sql() + """, t AS (SELECT n, y_y - y_x ** 2 / x_x AS r, y_y - hy ** 2 / a - (y_x - hy) ** 2 / (x_x - a) AS u FROM s)
    SELECT (r - u) / (u / (n - 4)) AS f, 1::bigint AS df1, n - 4 AS df2 FROM t""", "f", 4)
def iv_endogeneity(spark, folder):
    return R.as_table(spark, V.dwh_test(V.iv_model(hidden(spark, folder), "y", ["w"], ["x"], ["z1", "z2"]))).drop("p")


@query("iv_sargan", _iv_sql() + f""", g AS (SELECT n, rss, j11, j12, j22, y_z1 - b * x_z1 AS g1, y_z2 - b * x_z2 AS g2 FROM s),
    t AS (SELECT n * (j11 * g1 ** 2 + 2 * j12 * g1 * g2 + j22 * g2 ** 2) / rss AS stat FROM g)
    SELECT 'sargan' AS test, stat, 1::bigint AS df, {sql_p_chi2('stat', '1')} AS p FROM t""", "stat p")
def iv_sargan(spark, folder):
    return R.as_table(spark, V.overid_test(V.iv_model(hidden(spark, folder), "y", ["w"], ["x"], ["z1", "z2"])))


@query(
    "iv_hansen_j",
    f"""
    WITH r AS ({HIDDEN_SQL}), m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z1) AS m1, avg(z2) AS m2 FROM r),
    c AS (SELECT y - my AS y, x - mx AS x, z1 - m1 AS z1, z2 - m2 AS z2 FROM r, m),
    s AS (SELECT sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS d, sum(z1 * x) AS x1, sum(z2 * x) AS x2, sum(z1 * y) AS y1, sum(z2 * y) AS y2 FROM c),
    i AS (SELECT *, (d * x1 * y1 - b * (x1 * y2 + x2 * y1) + a * x2 * y2) / (d * x1 * x1 - 2 * b * x1 * x2 + a * x2 * x2) AS slope FROM s),
    o AS (SELECT sum((y - slope * x) ** 2 * z1 * z1) AS a, sum((y - slope * x) ** 2 * z1 * z2) AS b, sum((y - slope * x) ** 2 * z2 * z2) AS d,
      any_value(x1) AS x1, any_value(x2) AS x2, any_value(y1) AS y1, any_value(y2) AS y2 FROM c, i),
    g AS (SELECT *, (d * x1 * y1 - b * (x1 * y2 + x2 * y1) + a * x2 * y2) / (d * x1 * x1 - 2 * b * x1 * x2 + a * x2 * x2) AS slope FROM o),
    j AS (SELECT (d * (y1 - slope * x1) ** 2 - 2 * b * (y1 - slope * x1) * (y2 - slope * x2) + a * (y2 - slope * x2) ** 2) / (a * d - b * b) AS stat FROM g)
    SELECT 'hansen_j' AS test, stat, 1::bigint AS df, {sql_p_chi2('stat', '1')} AS p FROM j
    """,
    "stat p",
)
def iv_hansen_j(spark, folder):
    rows = hidden(spark, folder)
    return R.as_table(spark, V.overid_test(V.iv_model(rows, "y", [], ["x"], ["z1", "z2"]), rows))


_PROJECTED = """, h AS (SELECT l_suppkey, n, b, bw, a, (y - m_y) - b * (x - m_x) - bw * (w - m_w) AS e,
    p1 * ((z1 - m_z1) - w_z1 / ww * (w - m_w)) + p2 * ((z2 - m_z2) - w_z2 / ww * (w - m_w)) AS xh FROM r, s) """


@query("iv_robust", _iv_sql() + _PROJECTED + "SELECT 'x' AS term, any_value(b) AS coef, sqrt(sum((xh * e) ** 2)) / any_value(a) AS se FROM h", "coef se", 7)
def iv_robust(spark, folder):
    rows = hidden(spark, folder)
    fit = V.iv2sls(V.iv_model(rows, "y", ["w"], ["x"], ["z1", "z2"]))
    return R.robust_cov(fit, rows, "HC0").table(spark).where("term = 'x'").select("term", "coef", "se")


@query(
    "iv_cluster",
    _iv_sql() + _PROJECTED
    + ", g AS (SELECT any_value(b) AS b, any_value(a) AS a, sum(xh * e) AS g FROM h GROUP BY l_suppkey) SELECT 'x' AS term, any_value(b) AS coef, sqrt(sum(g ** 2)) / any_value(a) AS se FROM g",
    "coef se",
    7,
)
def iv_cluster(spark, folder):
    rows = hidden(spark, folder)
    fit = V.iv2sls(V.iv_model(rows, "y", ["w"], ["x"], ["z1", "z2"]))
    return R.cluster_cov(fit, rows, "l_suppkey", "CR0").table(spark).where("term = 'x'").select("term", "coef", "se")
