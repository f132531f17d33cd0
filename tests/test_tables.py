import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmetrica.functions.scalars import hash_uniform
from sparkmetrica.functions.vectors import vec_cosine, vec_dist, vec_dot, vec_norm
from sparkmetrica.operators import arrays as A
from sparkmetrica.operators import tables as X
from sparkmetrica.sources import pages as P
from sparkmetrica.sources.tables import coerce, load, save


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_save_and_load(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i int, s string, x double")
    save(rows, str(tmp_path / f"t.{fmt}"), fmt)
    back = load(spark, str(tmp_path), "t", fmt, None if fmt == "parquet" else rows.schema)
    assert sorted(back.select("i", "s", "x").collect()) == sorted(rows.collect())
    if fmt != "parquet":
        with pytest.raises(ValueError):
            load(spark, str(tmp_path), "t", fmt)


def test_coerce_keeps_rejects(spark):
    rows = spark.createDataFrame([("1", "2024-01-05", "k"), ("x", "2024-01-05", "l"), (None, "no", "m")], "n string, d string, k string")
    clean, rejects = coerce(rows, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType())]))
    assert clean.collect() == [(1, datetime.date(2024, 1, 5), "k")]
    assert {r["k"]: r["bad_columns"] for r in rejects.collect()} == {"l": ["n"], "m": ["d"]}


def test_profile_counts_nan_as_missing(spark):
    rows = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, None), (3.0, "b")], "x double, s string")
    for exact in (True, False):
        got = {r["column"]: r for r in X.profile(rows, exact=exact).collect()}
        assert (got["x"]["count"], got["x"]["missing"], got["x"]["distinct"], got["x"]["mean"]) == (2, 2, 2, 2.0)
        assert (got["s"]["missing_share"], got["s"]["distinct"], got["s"]["mean"]) == (0.25, 2, None)


def test_standardised_columns(spark):
    rows = spark.createDataFrame([([float(i), float(i * i), 4.0],) for i in range(9)], "x array<double>")
    z = A.axis_standardize(rows, "x")
    stats = A.axis_stats(z, "x").orderBy("dim").collect()
    assert [round(s["mean"], 12) for s in stats[:2]] == [0, 0] and [round(s["sd"], 12) for s in stats[:2]] == [1, 1]
    assert stats[2]["n"] == 0  # a constant dimension cannot be scaled


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vec_dot("a", "b"), vec_norm("a"), vec_cosine("a", "b"), vec_dist("a", "b"), vec_cosine("a", "z")).first()
    assert tuple(got) == (3.0, 5.0, 0.6, np.sqrt(20.0), None)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_matmul_against_numpy(spark, block):
    r = np.random.default_rng(1)
    a, b = r.integers(-3, 4, (7, 5)).astype(float), r.integers(-3, 4, (5, 6)).astype(float)
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i bigint, j bigint, v double")
    out = np.zeros((7, 6))
    for row in A.matmul(long(a), long(b), block).collect():
        out[row["i"], row["j"]] = row["v"]
    np.testing.assert_allclose(out, a @ b)


def test_matmul_of_a_table_with_itself(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (1, 1, 1.0)], "i bigint, j bigint, v double")
    assert sorted(map(tuple, A.matmul(m, m, 1).collect())) == [(0, 0, 6.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 7.0)]


def test_matmul_gives_no_cells_without_a_common_index(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 3.0), (1, 1, 1.0), (2, 0, 0.0)], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(0, 5, 7.0), (9, 0, 1.0)], "i bigint, j bigint, v double")
    assert sorted(map(tuple, A.matmul(a, b, 4).collect())) == [(0, 5, 14.0), (2, 5, 0.0)]


def test_gram_is_the_same_on_any_partitioning(spark):
    r = np.random.default_rng(2).normal(size=(200, 4))
    rows = spark.createDataFrame([(list(map(float, v)),) for v in r], "x array<double>")
    for parts in (1, 9):
        got = np.zeros((4, 4))
        for e in A.gram(rows.repartition(parts), "x", centred=True).collect():
            got[e["i"], e["j"]] = e["v"]
        np.testing.assert_allclose(got / 199, np.cov(r.T), rtol=1e-9)


def test_digitize_edges_and_missing(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (None,), (float("nan"),)], "x double")
    assert [r["bin"] for r in A.digitize(rows, "x", [1, 2]).collect()] == [0, 1, 2, None, None]


def test_hash_uniform_parts_are_independent_and_stable(spark):
    got = spark.range(5000).select(*[hash_uniform("id", "s", p).alias(f"u{p}") for p in range(4)]).toPandas()
    assert abs(got.corr().to_numpy() - np.eye(4)).max() < 0.05 and got.to_numpy().min() >= 0 and got.to_numpy().max() < 1
    assert abs(got.mean() - 0.5).max() < 0.02


def test_topk_limits_groups_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = X.topk(rows, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial", plan.index("WindowGroupLimit"))
    assert plan.index("Exchange") < partial  # the partial limit is below the exchange


def test_filters_and_columns_reach_the_scan(spark):
    li = load(spark, "/root/testdata/sf0.001", "lineitem").where("l_discount > 0.05D")
    plan = X.group_summary(li, ["l_returnflag"], {"n": F.count("*")})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.05)" in plan and "ReadSchema: struct<l_discount:double,l_returnflag:string>" in plan


@pytest.mark.parametrize("html, text", [
    ("<p>a<br>b</p>", "a b"), ("<script>x('</p>')</script>ok", "ok"), ("<!-- no -->yes", "yes"),
    ("1 &lt; 2 &amp;amp; &quot;q&quot;&nbsp;", '1 < 2 &amp; "q"'), ("<b unclosed", "<b unclosed"),
    ("&copy; 2024 &middot; &eacute;&#233;&#xE9; &#x1F600;", "© 2024 · ééé 😀"), ("a & b &unknown; &amp &#0; &#xD800; &#99999999;", "a & b &unknown; &amp &#0; &#xD800; &#99999999;"),
    ("&Alpha;&alpha;&apos;", "Αα'"),
])
def test_strip_tags(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(P.strip_tags("h")).first()[0] == text


def test_no_quartiles_no_outliers(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert X.iqr_outliers(rows, "v").count() == 0 and X.winsorize(rows, "v").count() == 2


def test_extract_types_and_hits(spark):
    pages = spark.createDataFrame([("u1", "<i>price: 12.5</i>"), ("u2", "<i>price: n/a</i>"), ("u3", ""), ("u4", None)], "url string, html string")
    records = P.extract(pages, {"price": P.Rule(r"price: ([^<]*)", type="double")})
    assert [(r["price"], r["price_hit"]) for r in records.orderBy("url").collect()] == [(12.5, True), (None, True), (None, False), (None, False)]
    got = P.coverage(records, ["price"]).first()
    assert (got["pages"], got["hits"], got["typed"]) == (4, 2, 1)


def test_extract_all_matches(spark):
    pages = spark.createDataFrame([("u", "<b>1</b><b>x</b><b>3</b>"), ("v", "")], "url string, html string")
    got = P.extract(pages, {"n": P.Rule(r"<b>(.*?)</b>", type="int", many=True)}).orderBy("url").collect()
    assert [(r["n"], r["n_hit"]) for r in got] == [([1, None, 3], True), ([], False)]


def test_urls_and_listings(spark):
    rows = spark.createDataFrame(
        [(1, "HTTP://Site.com/Flat/1/?a=b", "2024-01-01"), (2, "http://site.com/Flat/1#top", "2024-02-01"), (3, "http://site.com/Flat/2", "2024-01-01")],
        "id int, url string, d string",
    )
    assert P.dedupe_listings(rows, {"u": P.normal_url("url")}, "d", "id").count() == 3  # ?a=b may be another page
    kept = P.dedupe_listings(rows, {"u": P.normal_url("url", drop=["a"])}, "d", "id")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3] and kept.columns == rows.columns


def test_snapshot_difference_shuffles_each_side_once(spark):
    orders = load(spark, "/root/testdata/sf0.001", "orders")
    sides = [P.snapshot(orders, "o_custkey", "o_orderdate", F.lit(d).cast("timestamp_ntz"), "o_orderkey") for d in ("1996-12-31", "1998-12-31")]
    plan = P.diff(*sides, "o_custkey", ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_dedupe_keeps_one_whole_row_per_key(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), (None, 1, 1, "z"), (None, 0, 9, "w")], "k string, i int, t int, s string")
    assert sorted(X.dedupe(rows, ["k"], ["t", "i"]).collect(), key=str) == sorted([("a", 2, 5, "y"), (None, 0, 9, "w")], key=str)
    assert X.dedupe(rows.union(rows)).count() == 4


def test_snapshots_and_their_difference(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1.0, 1), ("a", "2024-03-01", 2.0, 2), ("b", "2024-01-05", 5.0, 3), ("c", "2024-02-20", 7.0, 4)], "k string, d string, p double, i int")
    first, second = P.snapshot(rows, "k", "d", "2024-01-31", "i"), P.snapshot(rows, "k", "d", "2024-03-31", "i")
    got = {r["k"]: (r["status"], r["p_before"], r["p_after"]) for r in P.diff(first, second, "k", ["p"]).collect()}
    assert got == {"a": ("changed", 1.0, 2.0), "b": ("same", 5.0, 5.0), "c": ("added", None, 7.0)}


def test_fill_missing_per_group_leaves_empty_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan")), (None, 4.0), (None, None)], "g string, x double")
    got = sorted((r["g"] or "", r["x"]) for r in X.fill_missing(rows, "x", "mean", "g").where("x IS NOT NULL").collect())
    assert got == [("", 4.0), ("", 4.0), ("a", 1.0), ("a", 1.0)]


def test_pages_to_price_factors(spark):
    """The whole path: collected pages, records, one row per listing, regression."""
    from sparkmetrica.operators import regression as R
    from tests.fixtures import listings

    base = listings(spark, 1500).select("id", "area", "dist", "price")
    html = F.format_string("<html><b>%.2f m2</b><i>%.3f km</i><u>%.2f EUR</u></html>", "area", "dist", "price")
    url = F.format_string("http://homes.example.org/%d?v=%d", "id", F.col("id") % 2)
    pages = base.select(url.alias("url"), html.alias("html"), F.lit("2024-04-14").alias("as_of"))
    pages = pages.union(pages.where("url LIKE '%7%'").withColumn("as_of", F.lit("2024-04-01")))
    rules = {n: P.Rule(p, type="double") for n, p in {"area": r"<b>([0-9.]+) m2", "dist": r"<i>([0-9.]+) km", "price": r"<u>([0-9.]+) EUR"}.items()}
    records = P.extract(pages, rules, ["url", "as_of"])
    flats = P.dedupe_listings(records, {"u": P.normal_url("url")}, "as_of", "url")
    assert flats.count() == 1500
    rows, names = R.design(flats, ("log", "price"), [("log", "area"), "dist"])
    assert R.ols(rows, "y", names).slopes == pytest.approx([0.8, -0.05], abs=0.1)


def test_matmul_of_dense_and_sparse_blocks(spark):
    r = np.random.default_rng(4)
    a, b = np.zeros((40, 40)), np.zeros((40, 40))
    a[:16, :16], b[:16, :20] = r.integers(1, 5, (16, 16)), r.integers(1, 5, (16, 20))  # dense blocks, and a block beside them with few columns
    for m in (a, b):
        m[r.integers(0, 40, 12), r.integers(0, 40, 12)] = 7
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i bigint, j bigint, v double")
    out = np.zeros((40, 40))
    for row in A.matmul(long(a), long(b), 16).collect():
        out[row["i"], row["j"]] += row["v"]
    np.testing.assert_allclose(out, a @ b)


@pytest.mark.parametrize("dense", [0.0, 1 / 16, 2.0])
def test_missing_values_mean_the_same_in_dense_and_sparse_blocks(spark, monkeypatch, dense):
    monkeypatch.setattr(A, "DENSE", dense)
    a = spark.createDataFrame([(0, 0, None), (0, 1, 5.0), (0, 4, 2.0), (1, 0, 2.0), (9, 0, None)], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(0, 0, 3.0), (1, 0, 1.0), (4, 0, 1.0), (1, 1, None), (0, 1, 8.0)], "i bigint, j bigint, v double")
    assert sorted(map(tuple, A.matmul(a, b, 4).collect())) == [(0, 0, 2.0), (0, 1, None), (1, 0, 6.0), (1, 1, None), (9, 0, None), (9, 1, None)]


def test_few_entries_make_no_blocks(spark):
    """Entries that lie far apart are joined: a block of this side would not fit in any memory."""
    a = spark.createDataFrame([(300 * k, 700 * k, 2.0) for k in range(50)], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(700 * k, 900 * k, 3.0) for k in range(50)], "i bigint, j bigint, v double")
    assert sorted(map(tuple, A.matmul(a, b, 1 << 20).collect())) == [(300 * k, 900 * k, 6.0) for k in range(50)]
