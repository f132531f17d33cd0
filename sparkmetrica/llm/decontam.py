"""Benchmark decontamination: MinHash containment search over size classes, verified exactly.

An item with ``q`` distinct shingles that is contained to ``t`` in a document misses at most
``q - ceil(t q)`` of them, so one of any ``q - ceil(t q) + 1`` of its shingles is in the
document. The sketch of an item is that many of its smallest shingle hashes (bottom-k
MinHash), ``k`` being set by the item's size class so that it holds for every size in the
class. A document that shares no sketch value with an item can't contain it; every
document that shares one is verified by the exact containment of the distinct shingles.
So a short item is found inside a document of any length, and none is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.llm.common import U, per_batch, rolling, words

SHINGLE = 5
THRESHOLD = 0.8
ITEM_BLOCK = 400_000  # distinct item shingles sent to the executors at once (3.2 MB)
FILTER_BITS = 22


def word_names(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def item_shingles(text: str | None) -> tuple[int, np.ndarray]:
    """Shingle length and distinct shingle names; an item of fewer words is one shingle."""
    names = word_names(words(text, lower=True))
    length = min(SHINGLE, len(names))
    return length, np.unique(rolling(names, length)) if length else np.zeros(0, np.uint64)


def sketch_size(n: int, threshold: float) -> int:
    """Sketch length of the size class of ``n``, the sizes from a power of two to the next."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - math.ceil(threshold * top - 1e-9) + 1)


class Items:
    """A block of benchmark items: sketches for the search, all shingles for the check."""

    def __init__(self, rows: list[tuple[int, int, bytes]], threshold: float):
        self.threshold = threshold
        self.ids = [r[0] for r in rows]
        self.sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.lengths = [r[1] for r in rows]
        owners: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(self.sets):
            for v in s[: sketch_size(len(s), threshold)].tolist():  # np.unique has sorted them
                owners.setdefault((self.lengths[i], v), []).append(i)
        self.owners = owners
        self.filters: dict[int, np.ndarray] = {}
        for length in set(self.lengths):
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[[v & ((1 << FILTER_BITS) - 1) for n, v in owners if n == length]] = True
            self.filters[length] = bits

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item number, shared shingles, shingles)`` of the items contained in a text."""
        names = word_names(words(text, lower=True))
        out = []
        for length, bits in self.filters.items():
            grams = rolling(names, length)
            maybe = grams[bits[(grams & U((1 << FILTER_BITS) - 1)).view(np.int64)]]
            if not len(maybe):
                continue
            near = {i for v in np.unique(maybe).tolist() for i in self.owners.get((length, v), ())}
            whole = np.unique(grams) if near else grams
            for i in sorted(near):
                s = self.sets[i]
                at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                shared = int((whole[at] == s).sum())
                if shared >= self.threshold * len(s) - 1e-9:
                    out.append((i, shared, len(s)))
        return out


def item_blocks(bench: DataFrame, id_col: str, text_col: str, threshold: float):
    """The benchmark as ``Items`` of bounded size, one at a time; equal rows count once, items without a word never match."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [item_shingles(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays(
            [batch.column("item"), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1].tobytes() for m in made], pa.binary()), pa.array([len(m[1]) for m in made], pa.int64())],
            ["item", "length", "names", "n"],
        )

    rows = bench.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        per_batch(run), "item long, length int, names binary, n long"
    )
    rows = rows.where("n > 0").distinct()
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = math.ceil(total / ITEM_BLOCK)
    for part in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item", "names"), F.lit(parts)) == part).select("item", "length", "names")
        yield Items([(r[0], r[1], bytes(r[2])) for r in block.collect()], threshold)


def contamination(
    docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(doc, item, shared, shingles, containment)`` for every item contained in a document to ``threshold``.

    Words are runs of non-white-space, A-Z in lower case; shingles are five words, an item of fewer words
    is one shingle. NULL and empty texts contain nothing and are contained nowhere. Rows with a
    NULL id are reported with it. The documents pass once for each block of items.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, item long, shared long, shingles long"
    out = None
    for items in item_blocks(bench, item_col, item_text_col, threshold):

        def run(batch: pa.RecordBatch, items=items) -> pa.RecordBatch:
            hits = [(d.as_py(), items.ids[i], s, n) for d, t in zip(batch.column("doc"), batch.column("text"), strict=True) for i, s, n in items.find(t.as_py())]
            return pa.RecordBatch.from_pylist([dict(zip(("doc", "item", "shared", "shingles"), h, strict=True)) for h in hits], schema=pa.schema([(c, pa.int64()) for c in ("doc", "item", "shared", "shingles")]))

        found = rows.mapInArrow(per_batch(run), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.where("false").selectExpr("doc", "doc AS item", "doc AS shared", "doc AS shingles")
    return out.withColumn("containment", F.col("shared") / F.col("shingles"))


def decontaminate(
    docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay as they are."""
    out = docs
    at = docs.columns.index(text_col)
    for items in item_blocks(bench, item_col, item_text_col, threshold):

        def run(batch: pa.RecordBatch, items=items) -> pa.RecordBatch:
            return batch.filter(pa.array([not items.find(t.as_py()) for t in batch.column(at)]))

        out = out.mapInArrow(per_batch(run), docs.schema)
    return out
