"""Trees, forests and boosted trees recounted from their training rows.

A fitted tree states for every node a share or mean, an impurity and the gain of its split. :func:`audit` recomputes all of them for all trees
from one grouped aggregate over the rows: sums by tree and leaf, added up to the nodes above. What travels is one row per leaf and task.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmetrica.session import file_system, shared_folder

NODE = "tree int, node int, depth int, feature int, threshold double, left int, right int, stated_n long, stated_mean double, stated_impurity double, stated_gain double"


def tree_weights(model) -> list[float]:
    return [float(w) for w in getattr(model, "treeWeights", [1.0])]


def boosted(model) -> bool:
    return type(model).__name__.startswith("GBT")


def nodes(spark, model) -> list[dict]:
    """All nodes of a fitted model by tree and preorder number, from the format that models are saved in.

    ``feature`` and ``threshold`` (left if not above) are NULL in leaves, the impurity where Spark has computed none; of a split by categories the threshold is NULL. The size is that of the
    model, whatever the number of rows.
    """
    folder = shared_folder(spark, "model")
    model.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    found = {(r["tree"], r["id"]): r for r in saved.collect()}
    system, path = file_system(spark, folder)
    system.delete(path, True)
    out, depth = [], {}
    for (tree, node), r in sorted(found.items()):
        at = depth.setdefault((tree, node), 0)
        leaf = r["leftChild"] < 0
        for child in () if leaf else (r["leftChild"], r["rightChild"]):
            depth[tree, child] = at + 1
        stats, split = r["impurityStats"], r["split"]
        if boosted(model):  # count, sum and sum of squares
            mean = stats[1] / stats[0]
        else:  # weight of each class
            mean = stats[1] / sum(stats) if len(stats) > 1 else 0.0
        ordered = not leaf and split["numCategories"] < 0
        out.append({
            "tree": tree, "node": node, "depth": at, "feature": None if leaf else split["featureIndex"],
            "threshold": split["leftCategoriesOrThreshold"][0] if ordered else None,
            "left": None if leaf else r["leftChild"], "right": None if leaf else r["rightChild"], "stated_n": r["rawCount"],
            "stated_mean": float(mean), "stated_impurity": r["impurity"] if r["impurity"] >= 0 else None, "stated_gain": None if leaf else r["gain"], "prediction": r["prediction"],
        })
    return out


def leaves_above(table: list[dict]) -> list[tuple[int, int, int]]:
    """``(tree, leaf, node)`` for every leaf, numbered from the left in each tree, and every node from it to the root."""
    at = {(r["tree"], r["node"]): r for r in table}
    out = []
    for tree in sorted({r["tree"] for r in table}):
        leaf, todo = 0, [(0, ())]
        while todo:
            node, above = todo.pop()
            path, r = (*above, node), at[tree, node]
            if r["left"] is None:
                out += [(tree, leaf, n) for n in path]
                leaf += 1
            else:
                todo += [(r["right"], path), (r["left"], path)]
    return out


def audit(model, rows: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """One row per tree and node: what the model states and the same recomputed from ``rows``, its training rows.

    ``n``, ``mean`` of the target, ``impurity`` (Gini of classes; variance in boosted trees) and ``gain`` (NULL in leaves). The target of a tree or forest is
    the label, that of a boosted tree is what the trees before it leave: -1 or 1 at first, later the negative slope of the
    logistic loss at their sum. Trees grown on resampled rows state numbers of those, so fit forests with ``bootstrap=False`` to
    compare them. Rows without label have no part. A node that no row reaches has ``n`` 0 and NULLs; empty ``rows`` make all of them so.
    """
    spark = rows.sparkSession
    table = nodes(spark, model)
    trees, boost = 1 + max(r["tree"] for r in table), boosted(model)
    reached = model.copy().setFeaturesCol(features).setLeafCol("_leaf").transform(
        rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), features)
    )
    leaf = F.array("_leaf") if reached.schema["_leaf"].dataType == T.DoubleType() else vector_to_array("_leaf")  # a single tree answers a number
    given = reached.select("_y", F.transform(leaf, lambda v: v.cast("int")).alias("_at"))
    if boost:
        last = {(t, n): k for t, k, n in leaves_above(table)}
        values = [[r["prediction"] for r in sorted((r for r in table if r["tree"] == t and r["left"] is None), key=lambda r: last[t, r["node"]])] for t in range(trees)]
        stated = F.array(*[F.array(*[F.lit(float(v)) for v in vs]) for vs in values])  # one number per leaf of the model
        weights = F.array(*[F.lit(w) for w in tree_weights(model)])
        sign = 2 * F.col("_y") - 1
        # sums of the trees before each: one pass along the trees of a row
        start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("before"))
        walk = F.aggregate(
            F.sequence(F.lit(0), F.lit(trees - 1)), start,
            lambda s, t: F.struct(
                (s["sum"] + F.get(weights, t) * F.get(F.get(stated, t), F.get(F.col("_at"), t))).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")
            ),
        )
        given = given.withColumn("_before", walk["before"])
        target = F.when(F.col("tree") == 0, sign).otherwise(4 * sign / (1 + F.exp(2 * sign * F.get(F.col("_before"), F.col("tree")))))
    else:
        target = F.col("_y")
    carried = ["_y", "_before"] if boost else ["_y"]
    long = given.select(*carried, F.posexplode("_at").alias("tree", "leaf")).select("tree", "leaf", target.alias("_t"))
    by_leaf = long.groupBy("tree", "leaf").agg(F.count("_t").alias("n"), F.sum("_t").alias("s"), F.sum(F.col("_t") * F.col("_t")).alias("q"))
    # both tables below have the size of the model
    above = spark.createDataFrame(leaves_above(table), "tree int, leaf int, node int")
    at_node = F.broadcast(above).join(by_leaf, ["tree", "leaf"]).groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.try_divide(F.col("s"), F.col("n"))
    spread = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
    sums = at_node.select("tree", "node", "n", mean.alias("mean"), (spread if boost else 2 * mean * (1 - mean)).alias("impurity"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    own = spark.createDataFrame([tuple(r[c] for c in columns) for r in table], NODE).join(F.broadcast(sums), ["tree", "node"], "left")
    child = lambda side: sums.select("tree", F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("impurity").alias(f"i_{side}"))
    both = own.join(F.broadcast(child("left")), ["tree", "left"], "left").join(F.broadcast(child("right")), ["tree", "right"], "left")
    part = lambda side: F.coalesce(F.col(f"n_{side}") * F.col(f"i_{side}"), F.lit(0.0))
    gain = F.when(F.col("feature").isNotNull(), F.col("impurity") - F.try_divide(part("left") + part("right"), F.col("n")))
    return both.select(
        "tree", "node", "depth", "feature", "threshold", F.coalesce("n", F.lit(0)).alias("n"), "mean", "impurity", gain.alias("gain"),
        "stated_n", "stated_mean", "stated_impurity", "stated_gain",
    )


def certificate(audited: DataFrame) -> DataFrame:
    """Per tree of an audit: nodes, rows at the root, and the largest difference between what is stated and what the rows say.

    A node that no row reaches counts as a difference of 1.
    """
    gaps = [F.abs(F.col(f"stated_{c}") - F.col(c)) for c in ("mean", "impurity", "gain")]
    counts = F.abs(F.col("stated_n") - F.col("n")).cast("double")
    worst = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.greatest(counts, *[F.coalesce(g, F.lit(0.0)) for g in gaps]))
    return audited.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.max(F.when(F.col("node") == 0, F.col("n"))).alias("n"),
        F.max(F.when(F.col("node") == 0, F.col("mean"))).alias("mean"), F.max(worst).alias("gap"),
    )
