"""Maths on array columns (one vector per row) and on long matrices ``(i, j, v)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import num
from sparkmetrica.functions.vectors import literal_vector, vec_dist, vec_dot
from sparkmetrica.session import discard, settle


def axis_stats(df: DataFrame, column: str) -> DataFrame:
    """Per-dimension count, mean, sd, min and max over all rows."""
    entries = df.select(F.posexplode(column).alias("dim", "v")).select("dim", num("v").alias("v"))
    return entries.groupBy("dim").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def axis_standardize(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Each dimension to mean 0 and sd 1. A constant dimension becomes NULL."""
    # one row per dimension of a single array: bounded by the length of a row
    stats = axis_stats(df, column).orderBy("dim").collect()
    mean = literal_vector([r["mean"] for r in stats])
    inverse = F.array(*[F.lit(1.0 / r["sd"] if r["sd"] else None).cast("double") for r in stats])
    centred = F.zip_with(F.col(column), mean, lambda v, m: v.cast("double") - m)
    return df.withColumn(name or column, F.zip_with(centred, inverse, lambda v, s: v * s))


def _partial_grams(column: str, centre: np.ndarray | None):
    def run(batches):
        total = None
        for batch in batches:
            vectors = batch.column(0).drop_null()
            if not len(vectors):
                continue
            lengths = np.diff(vectors.offsets.to_numpy())
            if lengths.min() != lengths.max() or (total is not None and lengths[0] != len(total)):
                raise ValueError("vectors of unequal length")
            block = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            block = block.reshape(len(vectors), -1)
            block = block[np.isfinite(block).all(axis=1)]  # a vector with a missing element counts as missing
            if not len(block):
                continue
            if centre is not None:
                block = block - centre
            total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            d = total.shape[0]
            i, j = np.indices((d, d))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i.ravel(), pa.int32()),
                    pa.array(j.ravel(), pa.int32()),
                    pa.array(total.ravel(), pa.float64()),
                ],
                names=["i", "j", "v"],
            )

    return run


def gram(df: DataFrame, column: str, centred: bool = False) -> DataFrame:
    """Sum of outer products ``x x'`` as ``(i, j, v)``; covariance sums if ``centred``.

    A vector with a NULL, NaN or infinite element is left out as a whole; vectors of unequal length are an error.

    Every partition reduces its own rows to one d-by-d matrix before anything is
    shuffled, so what travels is d^2 numbers per partition, whatever the row count.
    """
    centre = None
    if centred:
        whole = ~F.exists(F.col(column), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
        centre = np.array([r["mean"] for r in axis_stats(df.where(whole), column).orderBy("dim").collect()])
    partial = df.select(column).mapInArrow(_partial_grams(column, centre), "i int, j int, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def project(df: DataFrame, column: str, weights, name: str = "projected") -> DataFrame:
    """``x W`` for a small matrix ``W`` given as rows; the result is an array column."""
    columns = [[float(row[j]) for row in weights] for j in range(len(weights[0]))]
    return df.withColumn(name, F.array(*[vec_dot(column, literal_vector(c)) for c in columns]))


DENSE = 1 / 16  # share of entries from which a block counts as dense


def matmul(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """Product of two long matrices ``(i, j, v)``: dense blocks by blocks, all other entries by a join on the inner index.

    Two dense blocks with the same inner range are multiplied in one task, which
    holds at most ``2 * block^2`` entries, even if one row or column is dense. Where one of two
    blocks has few entries, its entries meet those of the other one by one, so the work grows with the
    entries that meet and not with the blocks. A missing
    value makes its row of the left block, or column of the right one, missing.
    """

    def cut(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(block)).cast("bigint")

    def entries(m: DataFrame, keys: dict, lines: list) -> tuple[DataFrame, DataFrame]:
        """Summed entries with their block, those of a line with a missing value missing, and the dense blocks."""
        rows = m.where("i IS NOT NULL AND j IS NOT NULL").groupBy("i", "j").agg(F.sum(num("v")).alias("v"))
        rows = settle(rows.withColumns({k: cut(c) for k, c in keys.items()}))
        gaps = settle(rows.where("v IS NULL").select(*lines, F.lit(True).alias("gap")).distinct())
        if not gaps.isEmpty():
            rows = settle(rows.join(gaps, lines, "left").withColumn("v", F.when(F.col("gap").isNull(), F.col("v"))).drop("gap"))
        dense = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DENSE * block * block).select(*keys, F.lit(True).alias("dense")))
        return rows, dense

    left, dense_left = entries(a, {"bi": "i", "bk": "j"}, ["i", "bk"])
    right, dense_right = entries(b, {"bk": "i", "bj": "j"}, ["bk", "j"])
    # the products of blocks to be made; entries are then joined by their own block,
    # so that a dense inner range does not gather in one task
    products = dense_left.drop("dense").join(dense_right.drop("dense"), "bk")
    # both sides of the cogroup descend from one table: fresh columns on the right
    others = products.select(*[F.col(c).alias(c) for c in ("bk", "bi", "bj")])

    def multiply(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        bi, bk, bj = key
        # second layer: 1 where there is an entry, so that absent cells stay absent
        m, n = np.zeros((2, block, block)), np.zeros((2, block, block))
        mi, mj = x["i"] - bi * block, x["j"] - bk * block
        ni, nj = y["i"] - bk * block, y["j"] - bj * block
        m[0, mi, mj], m[1, mi, mj] = x["v"], 1.0
        n[0, ni, nj], n[1, ni, nj] = y["v"], 1.0
        product = m @ n
        i, j = np.nonzero(product[1])
        return pd.DataFrame({"i": i + bi * block, "j": j + bj * block, "v": product[0, i, j]})

    keys = ["bi", "bk", "bj"]
    inside, meets = left.join(products, ["bi", "bk"]), right.join(others, ["bk", "bj"])
    blocks = inside.groupBy(*keys).cogroup(meets.groupBy(*keys)).applyInPandas(multiply, "i bigint, j bigint, v double")
    x = left.join(dense_left, ["bi", "bk"], "left").select(F.col("i").cast("bigint").alias("i"), F.col("j").alias("k"), F.col("v").alias("x"), F.col("dense").alias("dx"))
    y = right.join(dense_right, ["bk", "bj"], "left").select(F.col("i").alias("k"), F.col("j").cast("bigint").alias("j"), F.col("v").alias("y"), F.col("dense").alias("dy"))
    single = x.join(y, "k").where("dx IS NULL OR dy IS NULL").select("i", "j", (F.col("x") * F.col("y")).alias("v"))
    return blocks.unionByName(single).groupBy("i", "j").agg(F.sum("v").alias("v"))


def nearest(df: DataFrame, column: str, centers: dict, name: str = "nearest") -> DataFrame:
    """Label of, and distance to, the nearest of a few points (``label -> vector``).

    The points are a literal in the plan; ties go to the smaller label.
    """
    candidates = [
        F.struct(vec_dist(column, literal_vector(v)).alias("d"), F.lit(k).alias("label"))
        for k, v in centers.items()
    ]
    best = F.array_min(F.array(*candidates))
    return df.withColumn("_best", best).select(
        *df.columns, F.col("_best.label").alias(name), F.col("_best.d").alias("distance")
    )


def digitize(df: DataFrame, column: str, edges, name: str = "bin") -> DataFrame:
    """Number of edges at or below the value: 0 below the first edge. NULL stays NULL."""
    value = num(column)
    steps = [F.when(value >= F.lit(float(e)), 1).otherwise(0) for e in edges]
    return df.withColumn(name, F.when(value.isNotNull(), reduce(lambda a, b: a + b, steps)))


CENTRE_BYTES = 32 << 20
CELLS = 1 << 22  # distances that a task holds at once


def nearest_of(df: DataFrame, key: str, column: str, centres: DataFrame, label: str, vector: str, other: bool = False, block_bytes: int = CENTRE_BYTES) -> DataFrame:
    """``key, nearest, distance``: the label of the nearest of many centres for every row, ties to the smaller label.

    Centres are a table. They are sent to the tasks in blocks of at most ``block_bytes``, one after the other, and each task
    carries its rows' best so far. Rows are written after each block but the last, so that one block at a time is in the
    tasks' memory: neither it nor the plan grows with the number of centres. Inside a block distances come from one matrix
    product, ``|x|^2 - 2 x'c + |c|^2``; those within its rounding of the least are taken again from the differences.
    With ``other`` a row's own key is no centre for it. Rows and centres with a missing element have no part; without centres the answer is NULL.
    """
    spark = df.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(F.col(c), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    points = centres.where(whole(vector) & F.col(label).isNotNull()).select(F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("c"))
    facts = points.agg(F.count(F.lit(1)), F.max(F.size("c")), F.min(F.size("c"))).first()
    if facts[1] != facts[2]:
        raise ValueError("centres of unequal length")
    rows = df.where(whole(column)).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("x"), F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("distance"))
    kind = df.schema[key].dataType.simpleString()
    parts = -(-facts[0] * 8 * (facts[1] or 0) // block_bytes)
    numbered, written = points.withColumn("part", F.pmod(F.xxhash64("label", "c"), F.lit(max(parts, 1)))), None
    if parts > 1:
        numbered = settle(numbered)
    for part in range(parts):
        if part:
            before, written = written, settle(rows)
            rows = written
            discard(before)
            sent.unpersist()  # noqa: F821
        # about block_bytes: a hash deals the centres evenly
        block = numbered.where(F.col("part") == part).select("label", "c").toArrow().sort_by("label")
        sent = spark.sparkContext.broadcast((block.column("label").to_numpy(), block.column("c").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)))
        rows = rows.mapInArrow(_nearer(sent, other), f"key {kind}, x array<double>, nearest long, distance double")
    if parts > 1:
        discard(numbered)
    return rows.select(F.col("key").alias(key), "nearest", F.sqrt("distance").alias("distance"))


def _nearer(sent, other: bool):
    """Carries the best centre of each row through one block of centres; distances are squared."""

    def run(batches):
        labels, c = sent.value
        square = (c * c).sum(axis=1)
        step = max(1, min(1024, CELLS // max(len(c), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                if len(x) != n * c.shape[1]:
                    raise ValueError("rows and centres of unequal length")
                x = x.reshape(n, -1)
                keys = part.column("key").to_pylist()
                name = part.column("nearest").to_pylist()
                best = np.array([np.inf if v is None else v for v in part.column("distance").to_pylist()])
                size = (x * x).sum(axis=1)
                rough = (-2 * x) @ c.T
                rough += size[:, None]
                rough += square
                if other:
                    rough[np.array(keys)[:, None] == labels] = np.inf
                edge = np.minimum(rough.min(axis=1, initial=np.inf), best) + 1e-9 * (size + square.max(initial=0.0) + 1)
                for i, j in zip(*np.nonzero(rough <= edge[:, None]), strict=True):
                    far = float(((x[i] - c[j]) ** 2).sum())
                    if far < best[i] or far == best[i] and (name[i] is None or labels[j] < name[i]):
                        best[i], name[i] = far, int(labels[j])
                near = pa.array([None if v is None else d for v, d in zip(name, best.tolist(), strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("x"), pa.array(name, pa.int64()), near], ["key", "x", "nearest", "distance"])

    return run
