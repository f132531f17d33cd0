"""Array queries: row-wise maths, similarity, reductions over rows, matrix products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform
from sparkmetrica.functions.vectors import vec_cosine, vec_dist, vec_dot, vec_norm, vec_sum
from sparkmetrica.operators import arrays as A
from sparkmetrica.plans.registry import query, sql_uniform
from sparkmetrica.sources.tables import load

LONG_SQL = """
SELECT vec_id, label, i - 1 AS dim, e[i]::double AS v
FROM (SELECT vec_id, label, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
"""


@query(
    "array_rowwise",
    """
    SELECT vec_id,
      list_sum(list_transform(e, lambda v: 2 * v + 1)) AS scaled_sum,
      coalesce(list_sum(list_filter(e, lambda v: v > 0)), 0) AS positive_sum,
      len(list_filter(e, lambda v: v > 0))::int AS n_positive,
      list_max(e) AS biggest,
      list_position(e, list_max(e))::bigint AS arg_biggest,
      list_sum(list_slice(list_reverse_sort(e), 1, 3)) AS top3_sum,
      list_sum(list_slice(e, 1, len(e) // 2)) AS half_running_total,
      e[1] / list_sum(list_transform(e, lambda v: abs(v))) AS first_share
    FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)
    """,
    "scaled_sum positive_sum biggest top3_sum half_running_total first_share",
)
def array_rowwise(spark, folder):
    """Elementwise maths, masks, reductions, sort, arg-max, top-k and running total per row."""
    e = F.col("e")
    rows = load(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    add = lambda s, v: s + v
    running = F.aggregate(
        e, F.array().cast("array<double>"),
        lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))),
    )
    positive = F.filter(e, lambda v: v > 0)
    return rows.select(
        "vec_id",
        F.aggregate(F.transform(e, lambda v: 2 * v + 1), F.lit(0.0), add).alias("scaled_sum"),
        F.aggregate(positive, F.lit(0.0), add).alias("positive_sum"),
        F.size(positive).alias("n_positive"),
        F.array_max(e).alias("biggest"),
        F.array_position(e, F.array_max(e)).alias("arg_biggest"),
        vec_sum(F.slice(F.sort_array(e, asc=False), 1, 3)).alias("top3_sum"),
        F.element_at(running, F.floor(F.size(e) / 2).cast("int")).alias("half_running_total"),
        (e[0] / F.aggregate(e, F.lit(0.0), lambda s, v: s + F.abs(v))).alias("first_share"),
    )


@query(
    "vector_similarity",
    """
    WITH t AS (SELECT label, vec_id, embedding::double[] AS e FROM embeddings),
    f AS (SELECT label, arg_min(e, vec_id) AS c FROM t GROUP BY label)
    SELECT t.vec_id, list_dot_product(e, c) AS dot, sqrt(list_dot_product(e, e)) AS norm,
      list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))) AS cosine,
      sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - c[i]) * (e[i] - c[i])))) AS distance
    FROM t JOIN f USING (label)
    """,
    "dot norm cosine distance",
)
def vector_similarity(spark, folder):
    """Every vector against the first vector of its own label."""
    rows = load(spark, folder, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return rows.join(first, "label").select(
        "vec_id",
        vec_dot("embedding", "c").alias("dot"),
        vec_norm("embedding").alias("norm"),
        vec_cosine("embedding", "c").alias("cosine"),
        vec_dist("embedding", "c").alias("distance"),
    )


@query(
    "axis_stats",
    f"""
    SELECT dim::int AS dim, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max
    FROM ({LONG_SQL}) GROUP BY dim
    """,
    "mean sd min max",
)
def axis_stats(spark, folder):
    return A.axis_stats(load(spark, folder, "embeddings"), "embedding").withColumnRenamed("pos", "dim")


@query(
    "axis_standardize",
    f"""
    WITH l AS ({LONG_SQL}),
    s AS (SELECT dim, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY dim)
    SELECT vec_id, sum((v - m) / sd) AS total, sqrt(sum(((v - m) / sd) ** 2)) AS norm
    FROM l JOIN s USING (dim) GROUP BY vec_id
    """,
    "total norm",
)
def axis_standardize(spark, folder):
    got = A.axis_standardize(load(spark, folder, "embeddings"), "embedding", "z")
    return got.select("vec_id", vec_sum("z").alias("total"), vec_norm("z").alias("norm"))


@query(
    "gram_matrix",
    f"""
    WITH l AS ({LONG_SQL})
    SELECT a.dim::int AS i, b.dim::int AS j, sum(a.v * b.v) AS v
    FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2
    """,
    "v",
)
def gram_matrix(spark, folder):
    return A.gram(load(spark, folder, "embeddings"), "embedding")


@query(
    "covariance_matrix",
    f"""
    WITH l AS ({LONG_SQL})
    SELECT a.dim::int AS i, b.dim::int AS j, covar_samp(a.v, b.v) AS v
    FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2
    """,
    "v",
)
def covariance_matrix(spark, folder):
    rows = load(spark, folder, "embeddings")
    n = rows.agg(F.count("embedding")).scalar()
    return A.gram(rows, "embedding", centred=True).withColumn("v", F.col("v") / (n - 1))


@query(
    "project",
    """
    WITH t AS (SELECT vec_id, embedding::double[] AS e FROM embeddings)
    SELECT vec_id,
      list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * (i % 7 - 3))) AS p0,
      list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * ((2 * i) % 7 - 3))) AS p1
    FROM t
    """,
    "p0 p1",
)
def project(spark, folder):
    rows = load(spark, folder, "embeddings")
    d = rows.select(F.size("embedding")).first()[0]
    weights = [[i * (j + 1) % 7 - 3 for j in range(2)] for i in range(1, d + 1)]
    got = A.project(rows, "embedding", weights)
    return got.select("vec_id", F.col("projected")[0].alias("p0"), F.col("projected")[1].alias("p1"))


@query(
    "matrix_product",
    """
    WITH a AS (SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    b AS (SELECT p_partkey AS k, p_size AS j, p_retailprice AS v FROM part)
    SELECT i, j::bigint AS j, sum(a.v * b.v) AS v FROM a JOIN b USING (k) GROUP BY 1, 2
    """,
    "v",
    digits=3,
)
def matrix_product(spark, folder):
    """Supplier by part quantities times part by size prices: value of each size per supplier."""
    li, part = load(spark, folder, "lineitem"), load(spark, folder, "part")
    a = li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    b = part.select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("j"), F.col("p_retailprice").alias("v"))
    return A.matmul(a, b)


@query(
    "nearest_center",
    f"""
    WITH l AS ({LONG_SQL}),
    c AS (SELECT label AS nearest, dim, avg(v) AS m FROM l GROUP BY 1, 2),
    d AS (SELECT vec_id, nearest, sqrt(sum((v - m) ** 2)) AS distance FROM l JOIN c USING (dim) GROUP BY 1, 2)
    SELECT vec_id, arg_min(nearest, distance) AS nearest, min(distance) AS distance FROM d GROUP BY vec_id
    """,
    "distance",
)
def nearest_center(spark, folder):
    """Nearest label mean. One mean vector per label is brought to the driver: ten labels."""
    rows = load(spark, folder, "embeddings")
    entries = rows.select("label", F.posexplode("embedding").alias("dim", "v"))
    means = entries.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c"))
    centers = {r["label"]: [p["m"] for p in r["c"]] for r in vectors.collect()}
    return A.nearest(rows.select("vec_id", "embedding"), "embedding", centers).drop("embedding")


@query(
    "digitize",
    """
    SELECT (CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 35 THEN 2 ELSE 3 END)::int AS bin,
      count(*) AS n, avg(l_extendedprice) AS mean_price
    FROM lineitem GROUP BY 1
    """,
    "mean_price",
)
def digitize(spark, folder):
    binned = A.digitize(load(spark, folder, "lineitem"), "l_quantity", [10, 20, 35])
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean_price"))


@query(
    "hash_uniform",
    f"""
    SELECT o_orderstatus, count(*) AS n, avg(u) AS mean_u, min(u) AS min_u, max(u) AS max_u
    FROM (SELECT o_orderstatus, {sql_uniform('o_orderkey', 'demo')} AS u FROM orders) GROUP BY 1
    """,
    "mean_u min_u max_u",
    digits=9,
)
def uniform(spark, folder):
    u = hash_uniform("o_orderkey", "demo")
    return load(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.avg(u).alias("mean_u"), F.min(u).alias("min_u"), F.max(u).alias("max_u")
    )


@query(
    "nearest_other",
    """
    WITH d AS (SELECT a.vec_id, b.vec_id AS nearest, sqrt(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: (p[1] - p[2]) ** 2))) AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    m AS (SELECT vec_id, min(distance) AS distance FROM d GROUP BY vec_id)
    SELECT vec_id, min(nearest) AS nearest, any_value(m.distance) AS distance FROM d JOIN m USING (vec_id) WHERE d.distance <= m.distance GROUP BY vec_id
    """,
    "distance",
)
def nearest_other(spark, folder):
    """Every embedding against all others as centres."""
    rows = load(spark, folder, "embeddings")
    return A.nearest_of(rows, "vec_id", "embedding", rows, "vec_id", "embedding", other=True)
