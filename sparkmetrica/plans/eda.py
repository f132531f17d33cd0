"""Table preparation and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmetrica.operators import order as O
from sparkmetrica.operators import tables as X
from sparkmetrica.plans.registry import query
from sparkmetrica.session import settle
from sparkmetrica.sources.tables import coerce, load

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@query(
    "load_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES),
)
def load_tables(spark, folder):
    return X.concat([load(spark, folder, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES])


def _profile_sql(table: str, column: str, numeric: bool) -> str:
    c = column
    if numeric:
        m = (
            f"avg({c}) AS mean, stddev_samp({c}) AS sd, "
            f"avg(({c} - m) ** 3) / pow(avg(({c} - m) ** 2), 1.5) AS skewness, "
            f"avg(({c} - m) ** 4) / pow(avg(({c} - m) ** 2), 2) - 3 AS kurtosis"
        )
        source = f"{table}, (SELECT avg({c}) AS m FROM {table})"
    else:
        m = "NULL::double AS mean, NULL::double AS sd, NULL::double AS skewness, NULL::double AS kurtosis"
        source = table
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, "
        f"(count(*) - count({c})) / count(*)::double AS missing_share, count(DISTINCT {c}) AS \"distinct\", "
        f"min({c})::varchar AS min, max({c})::varchar AS max, {m} FROM {source}"
    )


@query(
    "profile",
    " UNION ALL ".join(
        _profile_sql("lineitem", c, numeric)
        for c, numeric in (
            ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_linenumber", True),
            ("l_returnflag", False), ("l_partkey", True),
        )
    ),
    "missing_share mean sd skewness kurtosis",
    digits=5,
)
def profile(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag", "l_partkey"]
    return X.profile(load(spark, folder, "lineitem"), columns, exact=True)


LINEITEM = {"l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True,
            "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False}


@query(
    "profile_approx",
    " UNION ALL ".join(f"SELECT *, true AS near FROM ({_profile_sql('lineitem', c, numeric)})" for c, numeric in LINEITEM.items()),
    "missing_share mean sd skewness kurtosis",
    digits=4,
)
def profile_approx(spark, folder):
    """The default profile of every column beside exact distinct counts; ``near``: the sketch is within three standard errors (5 % each) of them."""
    rows = load(spark, folder, "lineitem")
    exact = X.distinct_counts(rows).withColumnRenamed("distinct", "true")
    near = F.abs(F.col("distinct") - F.col("true")) <= F.greatest(F.col("true") * 0.15, F.lit(1))
    found = X.profile(rows).join(exact, "column").withColumn("near", near)
    return found.withColumn("distinct", F.col("true")).drop("true")


@query(
    "distinct_counts",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem""" for c in LINEITEM),
)
def distinct_counts(spark, folder):
    """Exact distinct values of all columns: bitmaps for dense integers, long form for the rest."""
    return X.distinct_counts(load(spark, folder, "lineitem"))


@query(
    "quantile_sketches",
    "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, true AS q10, true AS q50, true AS q99 FROM lineitem GROUP BY 1",
)
def quantile_sketches(spark, folder):
    """Sketches by month and flag, written, read back and merged by flag; whether the rank of each quantile is within the stated error."""
    rows = load(spark, folder, "lineitem")
    monthly = settle(X.quantile_sketches(rows.withColumn("month", F.date_trunc("month", "l_shipdate")), "l_extendedprice", ["month", "l_returnflag"]))
    merged = X.sketch_quantiles(X.merge_sketches(monthly, ["l_returnflag"]), (0.1, 0.5, 0.99))
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    met = rows.select("l_returnflag", "l_extendedprice").join(F.broadcast(merged), "l_returnflag")  # three flags
    ranks = met.groupBy("l_returnflag").agg(
        *[F.first(c).alias(c) for c in ("n", "min", "max")],
        *[f((F.col("l_extendedprice") < F.col(q)).cast("int") if below else (F.col("l_extendedprice") <= F.col(q)).cast("int")).alias(f"{q}_{below}") for q in probs for below in (True, False) for f in (F.avg,)],
    )
    near = {q: (F.col(f"{q}_True") <= p + X.kll_error()) & (F.col(f"{q}_False") >= p - X.kll_error()) for q, p in probs.items()}
    return ranks.select("l_returnflag", "n", "min", "max", *[c.alias(q) for q, c in near.items()])


@query(
    "quantiles_exact",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, quantile_cont({c}, 0.05) AS q5, quantile_cont({c}, 0.25) AS q25,
        quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.975) AS q97_5 FROM lineitem"""
        for c in ("l_extendedprice", "l_quantity", "l_tax")
    ),
    "q5 q25 q50 q97_5",
)
def quantiles_exact(spark, folder):
    columns = ["l_extendedprice", "l_quantity", "l_tax"]
    return X.quantiles(load(spark, folder, "lineitem"), columns, (0.05, 0.25, 0.5, 0.975), exact=True)


@query(
    "quantiles_approx",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, true AS q25, true AS q50, true AS q75 FROM lineitem""" for c in ("l_extendedprice", "l_quantity", "l_tax")),
)
def quantiles_approx(spark, folder):
    """Whether the rank of each quantile by sketch is within the stated 1 / 10000 of the rows, give or take one row."""
    rows, columns = load(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"]
    found = {r["column"]: r for r in X.quantiles(rows, columns).collect()}  # one row per column
    parts = []
    for c in columns:
        slack = F.lit(1e-4) + F.lit(1.0) / F.count(c)
        near = [
            ((F.avg((F.col(c) < found[c][q]).cast("int")) <= F.lit(p) + slack) & (F.avg((F.col(c) <= found[c][q]).cast("int")) >= F.lit(p) - slack)).alias(q)
            for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
        ]
        parts.append(rows.agg(F.lit(c).alias("column"), F.count(c).alias("n"), *near).select("column", "n", "q25", "q50", "q75"))
    return X.concat(parts)


@query(
    "quantiles_by_group",
    """
    SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.1) AS q10,
      quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.9) AS q90
    FROM lineitem GROUP BY 1
    """,
    "q10 q50 q90",
)
def quantiles_by_group(spark, folder):
    return O.exact_quantiles(load(spark, folder, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.9), ["l_returnflag"])


@query(
    "derive_filter",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
    FROM lineitem WHERE l_discount > 0.05 AND l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'R'
    """,
    "charge",
    digits=6,
)
def derive_filter(spark, folder):
    li = load(spark, folder, "lineitem")
    kept = li.where("l_discount > 0.05D AND l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'R'")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return kept.select("l_orderkey", "l_linenumber", charge.alias("charge"))


@query(
    "group_summary",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, avg(l_extendedprice) AS mean_price,
      stddev_samp(l_extendedprice) AS sd_price, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY 1, 2
    """,
    "quantity mean_price sd_price",
    digits=4,
)
def group_summary(spark, folder):
    metrics = {
        "n": F.count("*"), "quantity": F.sum("l_quantity"), "mean_price": F.avg("l_extendedprice"),
        "sd_price": F.stddev_samp("l_extendedprice"), "suppliers": F.count_distinct("l_suppkey"),
    }
    return X.group_summary(load(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], metrics)


def _subtotal_sql(grouping: str) -> str:
    return f"""
    SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::bigint AS level,
      count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem GROUP BY {grouping}
    """


def _subtotals(spark, folder, keys, kind):
    metrics = {"n": F.count("*"), "quantity": F.sum("l_quantity")}
    return X.subtotals(load(spark, folder, "lineitem"), keys, metrics, kind)


@query("subtotals_rollup", _subtotal_sql("ROLLUP (l_returnflag, l_linestatus)"), "quantity", 3)
def subtotals_rollup(spark, folder):
    return _subtotals(spark, folder, ["l_returnflag", "l_linestatus"], "rollup")


@query("subtotals_cube", _subtotal_sql("CUBE (l_returnflag, l_linestatus)"), "quantity", 3)
def subtotals_cube(spark, folder):
    return _subtotals(spark, folder, ["l_returnflag", "l_linestatus"], "cube")


@query("subtotals_sets", _subtotal_sql("GROUPING SETS ((l_returnflag), (l_linestatus), ())"), "quantity", 3)
def subtotals_sets(spark, folder):
    return _subtotals(spark, folder, [["l_returnflag"], ["l_linestatus"], []], "sets")


@query(
    "value_counts",
    """
    SELECT p_brand, count(*) AS n, count(*) / (SELECT count(*) FROM part)::double AS share
    FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5
    """,
    "share",
)
def value_counts(spark, folder):
    return X.value_counts(load(spark, folder, "part"), "p_brand", 5)


@query(
    "crosstab",
    """
    SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O"
    FROM lineitem GROUP BY 1
    """,
)
def crosstab(spark, folder):
    return X.crosstab(load(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", F.count(F.lit(1)))


@query(
    "melt",
    """
    SELECT l_orderkey, l_linenumber, variable, value FROM (
      SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))
    """,
)
def melt(spark, folder):
    return X.melt(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "lookup_inner",
    """
    SELECT n_name, r_name, count(*) AS customers, sum(c_acctbal) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    """,
    "balance",
    digits=3,
)
def lookup_inner(spark, folder):
    c, n, r = (load(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = X.lookup(X.lookup(c, n, c.c_nationkey == n.n_nationkey), r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))


@query(
    "lookup_left",
    """
    SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS spent
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1
    """,
    "spent",
    digits=3,
)
def lookup_left(spark, folder):
    """Orders are summed per customer before the join, so a hot customer moves one row per task."""
    per = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent")
    )
    joined = X.lookup(load(spark, folder, "customer").select("c_custkey"), per, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query("lookup_semi", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def lookup_semi(spark, folder):
    big = load(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return X.lookup(load(spark, folder, "part"), big, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("lookup_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def lookup_anti(spark, folder):
    finished = load(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return X.lookup(load(spark, folder, "customer"), finished, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "concat_tables",
    """
    SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier
    """,
)
def concat_tables(spark, folder):
    c, s = load(spark, folder, "customer"), load(spark, folder, "supplier")
    return X.concat([
        c.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        s.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    ])


@query(
    "histogram",
    """
    WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)
    SELECT bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, n FROM (
      SELECT least(floor((o_totalprice - lo) / w), 19)::int AS bin, count(*) AS n FROM orders, r GROUP BY 1), r
    """,
    "lo hi",
)
def histogram(spark, folder):
    return X.histogram(load(spark, folder, "orders"), "o_totalprice", 20)


@query(
    "box_stats",
    """
    WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
      quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1)
    SELECT event_type, any_value(n) AS n, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75,
      min(value) FILTER (ok) AS whisker_lo, max(value) FILTER (ok) AS whisker_hi, count(*) FILTER (NOT ok) AS outliers
    FROM (SELECT *, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS ok FROM events JOIN q USING (event_type))
    GROUP BY 1
    """,
    "q25 q50 q75 whisker_lo whisker_hi",
)
def box_stats(spark, folder):
    return X.box_stats(load(spark, folder, "events"), "event_type", "value")


CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlations_pearson",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in CORR for b in CORR),
    "r",
)
def correlations_pearson(spark, folder):
    return X.correlations(load(spark, folder, "lineitem"), CORR)


SPEAR = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "correlations_spearman",
    "WITH r AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS {c}" for c in SPEAR)
    + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM r" for a in SPEAR for b in SPEAR),
    "r",
)
def correlations_spearman(spark, folder):
    return X.correlations(load(spark, folder, "lineitem"), SPEAR, "spearman")


@query(
    "iqr_outliers",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)
    """,
)
def iqr_outliers(spark, folder):
    return X.iqr_outliers(load(spark, folder, "events"), "value").select("event_id", "value")


@query(
    "winsorize",
    """
    WITH q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events)
    SELECT event_type, sum(greatest(least(value, b), a)) AS total, min(greatest(least(value, b), a)) AS lowest,
      max(greatest(least(value, b), a)) AS highest FROM events, q GROUP BY 1
    """,
    "total lowest highest",
    digits=4,
)
def winsorize(spark, folder):
    clipped = X.winsorize(load(spark, folder, "events"), "value", 0.05, 0.95)
    return clipped.groupBy("event_type").agg(F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


# events whose value is small lose it, so that there is something to fill
GAPS_SQL = "SELECT event_id, event_type, user_id, CASE WHEN value >= 5 THEN value END AS value FROM events"


def _gaps(spark, folder):
    value = F.when(F.col("value") >= 5, F.col("value"))
    return load(spark, folder, "events").select("event_id", "event_type", "user_id", value.alias("value"))


def _fill_sql(fill: str) -> str:
    return f"SELECT event_type, count(value) AS n, sum(value) AS total FROM (SELECT event_type, {fill} AS value FROM ({GAPS_SQL})) GROUP BY 1"


def _filled(df):
    return df.groupBy("event_type").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("fill_constant", _fill_sql("coalesce(value, 1.5)"), "total", 4)
def fill_constant(spark, folder):
    return _filled(X.fill_missing(_gaps(spark, folder), "value", 1.5))


@query("fill_mean", _fill_sql("coalesce(value, avg(value) OVER ())"), "total", 4)
def fill_mean(spark, folder):
    return _filled(X.fill_missing(_gaps(spark, folder), "value", "mean"))


@query("fill_median_by_group", _fill_sql("coalesce(value, median(value) OVER (PARTITION BY event_type))"), "total", 4)
def fill_median_by_group(spark, folder):
    return _filled(X.fill_missing(_gaps(spark, folder), "value", "median", "event_type"))


@query("fill_mean_by_user", _fill_sql("coalesce(value, avg(value) OVER (PARTITION BY user_id))"), "total", 4)
def fill_mean_by_user(spark, folder):
    return _filled(X.fill_missing(_gaps(spark, folder), "value", "mean", "user_id"))


@query("drop_missing", f"SELECT event_type, count(*) AS n, sum(value) AS total FROM ({GAPS_SQL}) WHERE value IS NOT NULL GROUP BY 1", "total", 4)
def drop_missing(spark, folder):
    return _filled(X.fill_missing(_gaps(spark, folder), "value", "drop"))


@query("dedupe_exact", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedupe_exact(spark, folder):
    return X.dedupe(load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "dedupe_latest",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def dedupe_latest(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return X.dedupe(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("topk_overall", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::int AS rank FROM orders ORDER BY rank LIMIT 10")
def topk_overall(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return X.topk(orders, [], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(
    "topk_per_group",
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::int AS rank
    FROM lineitem QUALIFY rank <= 3
    """,
)
def topk_per_group(spark, folder):
    li = load(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return X.topk(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@query(
    "topk_dense",
    """
    SELECT p_brand, p_partkey, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::int AS rank
    FROM part QUALIFY rank <= 2
    """,
)
def topk_dense(spark, folder):
    return X.topk(load(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size")], 2, "dense_rank")


@query(
    "group_share",
    """
    SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share,
      (o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) / avg(o_totalprice) OVER (PARTITION BY o_custkey) AS deviation FROM orders
    """,
    "share deviation",
)
def group_share(spark, folder):
    """The deviation is given relative to the group mean: means of whole cents sit on rounding edges."""
    shared = X.add_group_share(load(spark, folder, "orders"), ["o_custkey"], "o_totalprice")
    mean = F.col("o_totalprice") - F.col("deviation")
    return shared.select("o_orderkey", "share", (F.col("deviation") / mean).alias("deviation"))


WINDOW_SPEC = {"previous": ("lag", "value", 1), "moving": ("moving_mean", "value", 5), "total": ("running", "value")}
WINDOW_SQL = """
    SELECT event_id, lag(value) OVER w AS previous, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving,
      sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS total
    FROM events WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id)
"""


@query("window_features", WINDOW_SQL.format(by="user_id"), "previous moving total", 5)
def window_features(spark, folder):
    got = X.add_window(load(spark, folder, "events"), ["user_id"], ["ts", "event_id"], WINDOW_SPEC)
    return got.select("event_id", *WINDOW_SPEC)


@query("window_features_large_groups", WINDOW_SQL.format(by="event_type"), "previous moving total", 4)
def window_features_large_groups(spark, folder):
    """The same columns by event type, on the plan for groups too large for one task."""
    order = [F.col("ts"), F.col("event_id")]
    got = X.add_window(load(spark, folder, "events"), ["event_type"], order, WINDOW_SPEC, block_rows=1_000)
    return got.select("event_id", *WINDOW_SPEC)


@query(
    "resample_daily",
    "SELECT event_type, date_trunc('day', ts)::timestamp AS period, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2",
    "mean_value",
)
def resample_daily(spark, folder):
    metrics = {"n": F.count("*"), "mean_value": F.avg("value")}
    got = X.resample(load(spark, folder, "events"), "ts", "day", metrics, ["event_type"])
    return got.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(
    "resample_monthly",
    "SELECT date_trunc('month', o_orderdate)::timestamp AS period, count(*) AS n, sum(o_totalprice) AS revenue FROM orders GROUP BY 1",
    "revenue",
    digits=3,
)
def resample_monthly(spark, folder):
    got = X.resample(load(spark, folder, "orders"), "o_orderdate", "month", {"n": F.count("*"), "revenue": F.sum("o_totalprice")})
    return got.withColumn("period", F.col("period").cast("timestamp_ntz"))


# the text after '#' in the brand and the first word of the name: one is a number, one is not
COERCE_SQL = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_size::varchar END AS size, substr(p_brand, 7) AS brand FROM part"


def _untyped(spark, folder):
    size = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return load(spark, folder, "part").select("p_partkey", size.alias("size"), F.expr("substr(p_brand, 7)").alias("brand"))


COERCED = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("brand", T.IntegerType())])


@query("coerce_clean", f"SELECT size::int AS size, brand::int AS brand, p_partkey FROM ({COERCE_SQL}) WHERE try_cast(size AS int) IS NOT NULL")
def coerce_clean(spark, folder):
    return coerce(_untyped(spark, folder), COERCED)[0]


@query("coerce_rejects", f"SELECT count(*) AS n, count(DISTINCT size) AS texts FROM ({COERCE_SQL}) WHERE try_cast(size AS int) IS NULL")
def coerce_rejects(spark, folder):
    rejects = coerce(_untyped(spark, folder), COERCED)[1]
    return rejects.where(F.array_contains("bad_columns", "size")).agg(F.count("*").alias("n"), F.count_distinct("size").alias("texts"))


@query(
    "lump_rare",
    """
    WITH f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part)::double AS s FROM part GROUP BY 1)
    SELECT CASE WHEN s >= 0.04 THEN p_brand ELSE 'other' END AS p_brand, count(*) AS n FROM part JOIN f USING (p_brand) GROUP BY 1
    """,
)
def lump_rare(spark, folder):
    return X.lump_rare(load(spark, folder, "part"), "p_brand", 0.04).groupBy("p_brand").agg(F.count("*").alias("n"))
