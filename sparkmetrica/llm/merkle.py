"""Merkle manifest of a table: an append log of tree nodes in postorder, and proofs read from it.

Leaves are hashes of rows. The leaves of a group stand in order; every two neighbours make a node of the next level, a last one
without a neighbour is hashed alone, until one node is left. The groups' last nodes are the leaves of one more such tree.

A builder takes an aligned run of ``RUN`` leaves, so that its subtree is a subtree of the whole, and appends its nodes in the order
in which they are complete: a node follows its children, which is postorder. The builders' last nodes are
the leaves of the next tier of builders, until every tree has one. Where a node stands in such a log follows from sizes of subtrees alone
(:func:`position`), so a proof needs no index and no search: the log is addressed at the positions of the siblings.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmetrica.llm.common import per_batch
from sparkmetrica.operators.order import positions
from sparkmetrica.session import discard, settle, shared_folder

LEVELS = 12  # of a builder
RUN = 1 << LEVELS
ROOTS = ""  # key of the tree above the groups; the groups' keys are longer
LOG = "tier int, key string, run long, leaves long, total long, nodes binary"
NONE, BEFORE, AFTER = b"\0", b"\1", b"\2"


def height(leaves: int) -> int:
    """Levels above the leaves."""
    return (leaves - 1).bit_length()


def subtree(leaves: int, level: int) -> int:
    """Nodes of a subtree that is ``level`` levels high and holds so many leaves."""
    return sum(-(-leaves >> lower) for lower in range(level + 1))


def position(leaves: int, level: int, index: int) -> int:
    """Place of a node in the postorder of the tree over ``leaves`` leaves.

    Before its subtree begins, the leaves on its left have completed ``2 s - popcount(s)`` nodes; the node ends its own subtree.
    """
    start = index << level
    return 2 * start - start.bit_count() + subtree(min(leaves - start, 1 << level), level) - 1


def join_hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """The nodes over ``leaves``, ``levels`` levels high, in the order in which they are complete."""
    log, open_nodes = [], []  # of each level the node that waits for its neighbour

    def complete(node: str, level: int) -> None:
        log.append(node)
        if level == len(open_nodes):
            open_nodes.append(None)
        if level == levels:
            return
        if open_nodes[level] is None:
            open_nodes[level] = node
        else:
            left, open_nodes[level] = open_nodes[level], None
            complete(join_hash(left, node), level + 1)

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(levels):
        if level < len(open_nodes) and open_nodes[level] is not None:
            left, open_nodes[level] = open_nodes[level], None
            complete(join_hash(left), level + 1)
    return log


def siblings(log: str, leaves: int, levels: int, index: int) -> bytes:
    """The path above a leaf, 33 bytes a level: on which side the sibling is and its digest, at its place in the log."""
    path = []
    for level in range(levels):
        at, width = index >> level, -(-leaves >> level)
        other = at ^ 1
        if other < width:
            place = 64 * position(leaves, level, other)
            path.append((BEFORE if at & 1 else AFTER) + bytes.fromhex(log[place : place + 64]))
        else:
            path.append(NONE + bytes(32))
    return b"".join(path)


def steps(path: bytes):
    """``(side, digest)`` of each level of a path."""
    for at in range(0, len(path), 33):
        yield path[at : at + 1], path[at + 1 : at + 33].hex()


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    for side, other in steps(path):
        leaf = join_hash(leaf) if side == NONE else join_hash(other, leaf) if side == BEFORE else join_hash(leaf, other)
    return leaf


def proof_hash(path: bytes) -> str:
    return join_hash(*[other for side, other in steps(path) if side != NONE])


def field(value: Column) -> Column:
    """A value as ``-`` if NULL, else its length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A key that is never NULL and sorts like the group, NULL first and else by its UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def tier_runs(leaves: DataFrame, tier: int, total: Column) -> DataFrame:
    """Log rows of one tier over ``leaves(key, place, leaf, n)``: ``n`` leaves of the table itself are in the tree."""

    def build(key, rows):
        rows = rows.sort_by("place")
        levels = min(LEVELS, max(0, height(rows.column("n")[0].as_py()) - tier * LEVELS))
        log = append_log(rows.column("leaf").to_pylist(), levels)
        return pa.table({
            "tier": pa.array([tier], pa.int32()), "key": pa.array([key[0].as_py()], pa.string()), "run": pa.array([key[1].as_py()], pa.int64()),
            "leaves": pa.array([rows.num_rows], pa.int64()), "total": rows.column("n").slice(0, 1), "nodes": pa.array([bytes.fromhex("".join(log))], pa.binary()),
        })

    dealt = leaves.select("key", F.shiftright("place", LEVELS).alias("run"), F.col("place").cast("long").alias("place"), "leaf", total.cast("long").alias("n"))
    return dealt.groupBy("key", "run").applyInArrow(build, LOG)


def last_nodes(log: DataFrame) -> DataFrame:
    """The builders' last nodes as the leaves of the next tier."""
    return log.select("key", F.col("run").alias("place"), F.lower(F.hex(F.substring("nodes", -32, 32))).alias("leaf"), F.col("total").alias("n"))


def write_trees(leaves: DataFrame, folder: str) -> int:
    """Appends all tiers over ``leaves(key, place, leaf, n)`` to the log in ``folder``; answers how many there are."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    tiers = max(1, -(-height(most) // LEVELS)) if most else 0
    for tier in range(tiers):
        tier_runs(leaves, tier, F.col("n")).write.option("maxRecordsPerFile", 256).parquet(f"{folder}/{tier}")
        leaves = last_nodes(read_tier(spark, folder, tier))
    return tiers


def read_tier(spark: SparkSession, folder: str, tier: int) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{folder}/{tier}")


def run_paths(log: DataFrame, above: DataFrame) -> DataFrame:
    """``(key, run, path)`` of the builders below: from each to the root. ``above(key, run, path)`` leads on from the builders in ``log``."""

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, runs, paths = [], [], []
        for key, run, tier, leaves, total, nodes, path in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "tier", "leaves", "total", "nodes", "path")), strict=True):
            text, levels = nodes.hex(), min(LEVELS, max(0, height(total) - tier * LEVELS))
            for index in range(leaves):
                keys.append(key)
                runs.append(run * RUN + index)
                paths.append(siblings(text, leaves, levels, index) + path)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(runs, pa.int64()), pa.array(paths, pa.binary())], ["key", "run", "path"])

    return log.join(above, ["key", "run"]).mapInArrow(per_batch(extract), "key string, run long, path binary")


class Manifest:
    """The tree of a table. ``rows(doc, key, place, leaf, n, extras..)`` has its leaves, ``folder`` its log, ``root`` its root."""

    def __init__(self, rows: DataFrame, folder: str, groups: DataFrame, tiers: int, tops: int):
        self.spark, self.rows, self.folder, self.groups, self.tiers, self.tops = rows.sparkSession, rows, folder, groups, tiers, tops

    def group_paths(self) -> DataFrame:
        """``(key, run, path)``: from the last node of each group to the root."""
        above = self.spark.createDataFrame([(ROOTS, 0, b"")], "key string, run long, path binary")
        for tier in range(self.tops - 1, -1, -1):
            above = run_paths(read_tier(self.spark, f"{self.folder}/top", tier), above)
        found = self.groups.join(above.withColumnRenamed("run", "place").select("place", "path"), "place")
        return found.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("run"), F.col("subroot"), "path")

    def proofs(self) -> DataFrame:
        """The rows of the manifest with ``subroot, root, path``; ``path`` leads from the leaf to the root by the log."""
        if not self.tiers:
            return self.rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("subroot", "string"), ("root", "string"), ("path", "binary"))])
        ends = self.group_paths()
        above = ends.drop("subroot")
        for tier in range(self.tiers - 1, 0, -1):
            above = run_paths(read_tier(self.spark, f"{self.folder}/groups", tier), above)
        root = last_nodes(read_tier(self.spark, f"{self.folder}/top", self.tops - 1)).first()["leaf"]
        logs = read_tier(self.spark, f"{self.folder}/groups", 0).join(above, ["key", "run"]).join(ends.select("key", "subroot"), "key")
        rows = self.rows.withColumn("run", F.shiftright("place", LEVELS).cast("long"))
        names = self.rows.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.schema) + ", subroot string, root string, path binary"

        def extract(key, rows, log):
            one = {c: log.column(c)[0].as_py() for c in ("leaves", "total", "nodes", "path", "subroot")}
            text, levels, n = one["nodes"].hex(), min(LEVELS, height(one["total"])), rows.num_rows
            paths = [siblings(text, one["leaves"], levels, place % RUN) + one["path"] for place in rows.column("place").to_pylist()]
            return rows.select(names).append_column("subroot", pa.array([one["subroot"]] * n, pa.string())).append_column("root", pa.array([root] * n, pa.string())).append_column("path", pa.array(paths, pa.binary()))

        return rows.groupBy("key", "run").cogroup(logs.groupBy("key", "run")).applyInArrow(extract, schema)

    def nodes(self) -> DataFrame:
        """``(key, position, digest)`` of every node of the groups' trees; positions are places in the postorder of the whole tree."""

        def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, places, digests = [], [], []
            for key, run, tier, leaves, total, nodes in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "tier", "leaves", "total", "nodes")), strict=True):
                text, base = nodes.hex(), tier * LEVELS
                levels = min(LEVELS, max(0, height(total) - base))
                for level in range(levels + 1):
                    if level or not tier:  # leaves of a higher tier are in the log below
                        for index in range(-(-leaves >> level)):
                            place = 64 * position(leaves, level, index)
                            keys.append(key)
                            places.append(position(total, base + level, (run << LEVELS - level) + index))
                            digests.append(text[place : place + 64])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(digests, pa.string())], ["key", "position", "digest"])

        out = self.spark.createDataFrame([], "key string, position long, digest string")
        for tier in range(self.tiers):
            out = out.union(read_tier(self.spark, f"{self.folder}/groups", tier).mapInArrow(per_batch(spread), out.schema))
        return out


def build(docs: DataFrame, id_col: str, group_col: str, leaf: Column, **extras: Column) -> Manifest:
    """Writes the log of a table whose row hashes are ``leaf`` and whose groups' leaves ascend by ``id_col``.

    NULL ids come first, NULL is a group and the first one; rows of one id stand in order of their hash, repeated rows
    are leaves each. An empty table has no tree. ``extras`` are columns to keep in the rows.
    """
    spark = docs.sparkSession
    hashed = settle(docs.select(F.col(id_col).cast("long").alias("doc"), group_key(F.col(group_col)).alias("key"), leaf.alias("leaf"), *[c.alias(n) for n, c in extras.items()]))
    # Equal rows are told apart, so that a third of all rows may be copies of one; the table is written, so the numbers hold.
    told = hashed.withColumn("copy", F.monotonically_increasing_id())
    rows = positions(told, [F.col("doc").asc_nulls_first(), F.col("leaf"), F.col("copy")], ["key"])
    rows = settle(rows.select("doc", "key", (F.col("pos") - 1).cast("long").alias("place"), "leaf", F.col("pos_total").cast("long").alias("n"), *extras))
    discard(hashed)
    folder = shared_folder(spark, "merkle")
    tiers = write_trees(rows, f"{folder}/groups")
    if not tiers:
        return Manifest(rows, folder, rows.select(F.col("key").alias("group"), "place", F.col("leaf").alias("subroot")), 0, 0)
    ends = last_nodes(read_tier(spark, f"{folder}/groups", tiers - 1))
    groups = positions(ends.select(F.col("key").alias("group"), F.col("leaf").alias("subroot")), [F.col("group")])
    groups = settle(groups.select("group", "subroot", (F.col("pos") - 1).cast("long").alias("place"), F.col("pos_total").cast("long").alias("n")))
    tops = write_trees(groups.select(F.lit(ROOTS).alias("key"), "place", F.col("subroot").alias("leaf"), "n"), f"{folder}/top")
    return Manifest(rows, folder, groups, tiers, tops)


def verify(proved: DataFrame, claim: str) -> DataFrame:
    """``proved`` with ``proof_sha256``, the root ``folded_root`` that the leaves in column ``claim`` give with the paths, and whether it is the root.

    A NULL claim stands for the leaf itself.
    """
    names = [c for c in proved.columns if c != "path"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema if f.name != "path") + ", proof_sha256 string, folded_root string, verified boolean"

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = batch.column("path").to_pylist()
        claims = [c or leaf for c, leaf in zip(batch.column(claim).to_pylist(), batch.column("leaf").to_pylist(), strict=True)]
        folded = [fold(c, p) for c, p in zip(claims, paths, strict=True)]
        right = [f == r for f, r in zip(folded, batch.column("root").to_pylist(), strict=True)]
        out = [pa.array([proof_hash(p) for p in paths], pa.string()), pa.array(folded, pa.string()), pa.array(right, pa.bool_())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, "proof_sha256", "folded_root", "verified"])

    return proved.mapInArrow(per_batch(check), schema)
