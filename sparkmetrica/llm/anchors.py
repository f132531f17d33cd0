"""Removal of repeated word windows, by fixed-block anchors.

Every document is cut into reference blocks of ``ANCHOR`` words that do not overlap. A window of
``2 * ANCHOR`` words or more that occurs twice holds a whole reference block at one of its places, so probing the blocks with
every rolling window of ``ANCHOR`` words finds all repeats. Hits are extended to the windows of full length around
them, which are compared by 64-bit names; those that start earlier elsewhere are removed, and
neighbouring ones join to maximal repeats.

Names travel packed: each block of documents sends each of its distinct names once, as 32 bits in a
bucket (a name hits if the bucket has a reference block of it and another place), so neither a hot passage nor a large group of copies makes
a hot bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmetrica.llm.blocks import ENTRIES, REPLIES, Blocks, answered, entries, gathered, in_earlier_block, ordered, replies, runs
from sparkmetrica.llm.common import U, rolling, words

WINDOW = 20
LOW = U(0xFFFFFFFF)

ADDED = ("n_words", "n_removed", "span_starts", "span_lengths")


class WordBlock:
    """The words of a block of documents in order, and their windows."""

    def __init__(self, rows: pa.Table, window: int, buckets: int):
        self.rows = ordered(rows)
        self.window, self.anchor, self.buckets = window, window // 2, buckets
        self.words: list[bytes] = []
        sizes = []
        for t in self.rows.column("text"):
            found = words(t.as_py())
            sizes.append(len(found))
            self.words += found
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        n = len(self.words)
        self.names = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        start, left = self.ends - self.sizes, np.repeat(self.ends, self.sizes) - np.arange(n)
        long = np.repeat(self.sizes >= window, self.sizes)
        self.place = np.arange(n) - np.repeat(start, self.sizes)
        self.fits = np.flatnonzero(left >= window)
        self.probes = np.flatnonzero((left >= self.anchor) & long)

    def probe(self) -> None:
        """Distinct names of the rolling anchors, by bucket: ``keys``; ``back`` leads from probes to keys."""
        grams = rolling(self.names, self.anchor)[self.probes] if len(self.probes) else np.zeros(0, np.uint64)
        key = ((grams >> U(32)) % U(self.buckets) << U(32)) | (grams & LOW)
        self.keys, self.back, self.times = np.unique(key, return_inverse=True, return_counts=True)

    def first_entries(self, block: int) -> pa.Table:
        self.probe()
        reference = np.zeros(len(self.keys), np.uint8)
        reference[self.back[self.place[self.probes] % self.anchor == 0]] = 1
        marks = reference | ((self.times > 1).astype(np.uint8) << 1)
        return entries(block, self.keys >> U(32), (self.keys & LOW).astype(np.uint32), marks)

    def extend(self, hit: np.ndarray) -> None:
        """Windows around the hits, and their names: ``at``, ``first`` (of each name, its first window), ``back2``, sorted by bucket."""
        near = np.zeros(len(self.words) + 1, np.int64)
        near[self.probes[hit[self.back]] + 1] = 1
        near = np.cumsum(near)
        inside = near[self.fits + self.window - self.anchor + 1] - near[self.fits] > 0 if len(self.fits) else np.zeros(0, bool)
        self.at = self.fits[inside]
        full = rolling(self.names, self.window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        names, first, back = np.unique(full, return_index=True, return_inverse=True)
        bucket = (names >> U(32)) % U(self.buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.full, self.bucket, self.first, self.back2 = names[order], bucket[order], first[order], rank[back]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Words under a window that starts earlier, in another block or in this one."""
        again = np.ones(len(self.at), bool)
        again[self.first] = False
        again |= earlier.astype(bool)[self.back2]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, self.at[again], 1)
        np.add.at(edge, self.at[again] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def hits(key, rows):
    """Reducer: whether an anchor is a reference block somewhere and occurs at another place too."""
    rows, names, sizes, _ = gathered(rows, np.uint32)
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8)
    _, back = np.unique(names, return_inverse=True)
    places = np.bincount(back, 1 + (marks >> 1))
    reference = np.bincount(back, marks & 1)
    return replies(rows, 1, ((places > 1) & (reference > 0))[back], sizes)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every word removed that a repeated window of ``window`` words covers.

    A window is removed if its words also start earlier: in a row with a smaller id (NULL first, equal ids by text), or earlier
    in the same row; windows are judged on the input. The text column becomes the kept words joined by single spaces (NULL and empty
    texts become empty); added are ``n_words``, ``n_removed`` and the removed runs as ``span_starts`` and ``span_lengths`` in words.
    All other columns are kept, but for any that is named like an added one. Rows equal in id and text: the first keeps its words.
    """
    blocks = Blocks(docs, id_col, text_col, added=ADDED)
    n = blocks.count

    def anchors(key, rows):
        return WordBlock(rows, window, n).first_entries(key[0].as_py())

    def windows(key, rows, answers):
        block = WordBlock(rows, window, n)
        block.probe()
        block.extend(answered(answers, 1).astype(bool))
        return entries(key[0].as_py(), block.bucket, block.full)

    names = list(blocks.fields)

    def finish(key, rows, answers):
        block = WordBlock(rows, window, n)
        block.probe()
        block.extend(answered(answers, 1).astype(bool))
        gone = block.removed(answered(answers, 2))
        texts, counts, starts, lengths = [], [], [], []
        for end, size in zip(block.ends.tolist(), block.sizes.tolist(), strict=True):
            own = gone[end - size : end]
            s, k = runs(own)
            counts.append(int(own.sum()))
            starts.append(s)
            lengths.append(k)
            found = block.words[end - size : end]
            texts.append(b" ".join(w for w, g in zip(found, own.tolist(), strict=True) if not g) if counts[-1] else b" ".join(found))
        return pa.table({
            "doc": block.rows.column("doc"), "text": pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()),
            **{c: block.rows.column(c) for c in names},
            "n_words": pa.array(block.sizes), "n_removed": pa.array(counts, pa.int64()),
            "span_starts": pa.array(starts, pa.list_(pa.int64())), "span_lengths": pa.array(lengths, pa.list_(pa.int64())),
        })

    first = blocks.map(anchors, ENTRIES).groupBy("bucket").applyInArrow(hits, REPLIES)
    second = blocks.map_with(first, windows, ENTRIES).groupBy("bucket").applyInArrow(in_earlier_block(2), REPLIES)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, t) for c, t in blocks.fields.items()]])
    for c in ("n_words", "n_removed"):
        schema = schema.add(c, T.LongType())
    for c in ("span_starts", "span_lengths"):
        schema = schema.add(c, T.ArrayType(T.LongType()))
    out = blocks.map_with(first.union(second), finish, schema)
    back = {"doc": id_col, "text": text_col, **dict(zip(blocks.fields, blocks.carried, strict=True))}
    return out.toDF(*[back.get(c, c) for c in out.columns])
