"""Blocks of documents in id order, and exchanges of packed names between them.

Operators that need the order of documents or compare positions of all texts work on blocks: ranges of ids of a few
megabytes of text. A block is small enough for one task's memory, its number gives its order, and it
is a pure function of the id, so a task that runs again makes the same block.
Rows are ordered by id, NULL first, then by text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
GRID = 1000


class Cuts:
    """Ids at which blocks begin: quantiles of the ids, with even steps between them where there are more blocks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        ident = F.col(id_col).cast("long")
        share = [i / GRID for i in range(GRID + 1)]
        row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col)), F.percentile_approx(ident, share, 20 * GRID)).first()
        self.rows, size, at = row[0], row[1] or 0, row[2]
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / block_bytes))
        self.count = max(1, min(wanted, self.rows))
        inner = [i / self.count for i in range(1, self.count)]
        self.starts = np.unique(np.floor(np.interp(inner, share, np.array(at, np.float64))).astype(np.int64)) if at else np.zeros(0, np.int64)
        self.count = len(self.starts) + 1

    def of(self, ident: Column) -> Column:
        """Block number of an id; NULL ids are in block 0."""
        starts = self.starts

        def place(ids: pa.Array) -> pa.Array:
            found = np.searchsorted(starts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int64)
            found[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            return pa.array(found)

        return F.arrow_udf(place, "long")(ident.cast("long"))


def ordered(rows: pa.Table) -> pa.Table:
    """Rows of a block by id, NULL first, then by text, NULL first."""
    return rows.take(pa.compute.sort_indices(rows.select(["doc", "text"]), sort_keys=[("doc", "ascending"), ("text", "ascending")], null_placement="at_start"))


ENTRIES = "bucket long, block long, names binary, marks binary"
REPLIES = "block long, step int, bucket long, answer binary"


def entries(block: int, bucket: np.ndarray, names: np.ndarray, marks: np.ndarray | None = None) -> pa.Table:
    """A block's names, sorted by bucket, as one row for each bucket that has any."""
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = [*head[1:].tolist(), len(bucket)]
    cut = list(zip(head.tolist(), ends, strict=False))
    return pa.table({
        "bucket": pa.array(bucket[head].astype(np.int64)), "block": pa.array(np.full(len(head), block, np.int64)),
        "names": pa.array([names[s:e].tobytes() for s, e in cut], pa.binary()),
        "marks": pa.array([b"" if marks is None else marks[s:e].tobytes() for s, e in cut], pa.binary()),
    })


def answered(rows: pa.Table, step: int) -> np.ndarray:
    """The answers to a block's entries of one step, in the order of the entries."""
    own = rows.filter(pa.compute.equal(rows.column("step"), step)).sort_by("bucket")
    return np.frombuffer(b"".join(own.column("answer").to_pylist()), np.uint8)


def gathered(rows: pa.Table, kind) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows in the order of their blocks, the names of all, how many each row has, and their blocks."""
    rows = rows.sort_by("block")
    parts = [np.frombuffer(x, kind) for x in rows.column("names").to_pylist()]
    sizes = np.array([len(x) for x in parts])
    return rows, np.concatenate(parts), sizes, np.repeat(rows.column("block").to_numpy(), sizes)


def replies(rows: pa.Table, step: int, answer: np.ndarray, sizes: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    data = answer.astype(np.uint8)
    return pa.table({
        "block": rows.column("block"), "step": pa.array(np.full(len(sizes), step, np.int32)), "bucket": rows.column("bucket"),
        "answer": pa.array([data[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
    })


def in_earlier_block(step: int):
    """Reducer: whether a name is in a block before this one."""

    def run(key, rows):
        rows, names, sizes, block = gathered(rows, np.uint64)
        _, first, back = np.unique(names, return_index=True, return_inverse=True)
        return replies(rows, step, block > block[first][back], sizes)

    return run


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - edge[::2]


class Blocks:
    """Documents dealt into blocks under names of their own, so that no column of the input clashes.

    Columns of the input that are named like one of ``added`` are left out.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, added: tuple[str, ...] = ()):
        cuts = Cuts(docs, id_col, text_col, block_bytes)
        self.count = cuts.count
        self.carried = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in added]
        self.fields = {f"c{i}": docs.schema[c].dataType for i, c in enumerate(self.carried)}
        self.rows = docs.select(
            cuts.of(F.col(f"`{id_col}`")).alias("block"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"),
            *[F.col(f"`{c}`").alias(n) for n, c in zip(self.fields, self.carried, strict=True)],
        )

    def map(self, f, schema: str) -> DataFrame:
        return self.rows.groupBy("block").applyInArrow(f, schema)

    def map_with(self, answers: DataFrame, f, schema) -> DataFrame:
        return self.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema)
