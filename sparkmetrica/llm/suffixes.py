"""Removal of repeated byte strings: a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through ``WINDOW`` bytes, so the groups that remain equal are exactly the repeated windows. The digits
of a suffix are names of byte strings in it, and each pass sends only the groups on that are not settled yet:

1. the anchor: the ``ANCHOR`` bytes with the smallest hash in the window. Equal windows have the same anchor at the same
   place, and the windows around one anchor occurrence form a run, so one row stands for the whole run
   (about 40 suffixes). Anchors that occur once are settled.
2. the run: everything the run's windows cover. If all occurrences of an anchor stand in equal
   surroundings, their windows are equal one by one and settled.
3. the full depth: windows of the runs that are left are compared by names of all their bytes.

Names are 64-bit, so two different strings are taken for equal with probability about ``pairs / 2**64`` among strings that share an anchor.
The digit's bucket is the shuffle key. A block of documents sends each distinct name once, so hot passages and groups of copies don't
make a hot bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmetrica.llm.blocks import ENTRIES, REPLIES, Blocks, answered, entries, in_earlier_block, ordered, replies, runs
from sparkmetrica.llm.common import U, give_back, mix, rolling

WINDOW = 100
ANCHOR = 24
PART = 1 << 18  # windows handled at once
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
PAIR = np.dtype([("anchor", "<u8"), ("run", "<u8")])

ADDED = ("kept", "n_bytes", "n_removed", "span_starts", "span_lengths")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class ByteBlock:
    """The bytes of a block of documents in order, their windows and the runs around anchors."""

    def __init__(self, rows: pa.Table, window: int, anchor: int, buckets: int):
        self.rows, self.window, self.buckets = ordered(rows), window, buckets
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in self.rows.column("text").to_pylist()]
        self.data = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        del texts
        raw = np.frombuffer(self.data, np.uint8)
        n = len(raw) - window + 1
        fits = np.ones(max(n, 0), bool)
        for start, end in zip((self.ends - self.sizes).tolist(), self.ends.tolist(), strict=True):
            fits[max(start, end - window + 1) : end] = False
        self.full = np.zeros(max(n, 0), np.uint64)  # names of the windows
        span = window - anchor + 1
        low, high, where, named = [], [], [], []
        for s in range(0, n, PART):
            names = BYTE_NAMES[raw[s : s + PART + window - 1]]
            self.full[s : s + PART] = rolling(names, window)
            grams = rolling(names, anchor)
            key = (grams & ~U(2 * PART - 1)) | np.arange(len(grams), dtype=np.uint64)
            least = (sliding_min(key, span) & U(2 * PART - 1)).astype(np.int64)
            own = np.flatnonzero(fits[s : s + PART])
            if not len(own):
                continue
            least = least[own]
            head = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            low.append(own[head] + s)
            high.append(own[np.r_[head[1:], len(own)] - 1] + s)
            where.append(least[head] + s)
            named.append(grams[least[head]])
        none = np.zeros(0, np.int64)
        self.low, self.high, where = (np.concatenate([none, *x]) for x in (low, high, where))
        gram = np.concatenate([none.astype(np.uint64), *named])
        self.pairs = np.zeros(len(gram), PAIR)
        self.pairs["anchor"] = gram
        shape = ((where - self.low) * 1024 + self.high - self.low).astype(np.uint64)
        self.pairs["run"] = mix(self.full[self.low] * U(0x9E3779B97F4A7C15) + self.full[self.high] + mix(shape + U(1))) if len(gram) else 0
        bucket = (gram >> U(32)) % U(buckets)
        order = np.lexsort((self.pairs["run"], gram, bucket))
        sorted_pairs = self.pairs[order]
        new = np.r_[True, sorted_pairs[1:] != sorted_pairs[:-1]] if len(order) else np.zeros(0, bool)
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1  # from runs to distinct pairs
        self.distinct, self.bucket = sorted_pairs[new], bucket[order][new]
        self.first = order[new]  # lexsort is stable: the first run of each pair

    def refine(self, code: np.ndarray) -> None:
        """Keeps the codes of the runs, and names the windows of those not settled: ``at``, ``names``, ``first2``, ``back2``, by bucket."""
        self.code = code[self.back] if len(self.back) else code
        mixed = np.flatnonzero(self.code == 2)
        size = self.high[mixed] - self.low[mixed] + 1
        self.at = np.repeat(self.low[mixed] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        names, first, back = np.unique(self.full[self.at], return_index=True, return_inverse=True)
        bucket = (names >> U(32)) % U(self.buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.names, self.bucket2, self.first2, self.back2 = names[order], bucket[order], first[order], rank[back]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Bytes under a window that starts earlier, in another block or in this one."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        again = np.ones(len(self.code), bool)
        again[self.first] = False
        again = (again | (self.code == 1)) & (self.code != 2)
        np.add.at(edge, self.low[again], 1)
        np.add.at(edge, self.high[again] + self.window, -1)
        window = np.ones(len(self.at), bool)
        window[self.first2] = False
        window |= earlier.astype(bool)[self.back2]
        np.add.at(edge, self.at[window], 1)
        np.add.at(edge, self.at[window] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def judge(key, rows):
    """Reducer of the first two digits: 2 if an anchor stands in different surroundings, else whether an earlier block has it."""
    rows = rows.sort_by("block")
    parts = [np.frombuffer(x, PAIR) for x in rows.column("names").to_pylist()]
    sizes = np.array([len(x) for x in parts])
    pairs, block = np.concatenate(parts), np.repeat(rows.column("block").to_numpy(), sizes)
    _, first, back = np.unique(pairs["anchor"], return_index=True, return_inverse=True)
    differs = np.bincount(back, pairs["run"] != pairs["run"][first][back]) > 0
    code = np.where(differs[back], 2, block > block[first][back])
    return replies(rows, 1, code, sizes)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with every byte removed that a repeated string of ``window`` bytes covers.

    A string is repeated if it also starts earlier: in a row with a smaller id (NULL first, equal ids by text), or earlier in the same row;
    strings never cross documents and are judged on the input. The text column holds the kept bytes as text, less what
    is left of a character that was cut (NULL and empty texts become empty); added are ``kept`` (the kept bytes),
    ``n_bytes``, ``n_removed`` and the removed runs as ``span_starts`` and ``span_lengths`` in bytes. All other columns are kept, but for any that is named like an added one. Rows equal in id and text: the first keeps its bytes.
    """
    blocks = Blocks(docs, id_col, text_col, added=ADDED)
    n = blocks.count
    names = list(blocks.fields)

    def digits(key, rows):
        block = ByteBlock(rows, window, anchor, n)
        out = entries(key[0].as_py(), block.bucket, block.distinct)
        del block
        give_back()
        return out

    def depth(key, rows, answers):
        block = ByteBlock(rows, window, anchor, n)
        block.refine(answered(answers, 1))
        out = entries(key[0].as_py(), block.bucket2, block.names)
        del block
        give_back()
        return out

    def finish(key, rows, answers):
        block = ByteBlock(rows, window, anchor, n)
        block.refine(answered(answers, 1))
        gone = block.removed(answered(answers, 2))
        raw = np.frombuffer(block.data, np.uint8)
        kept, counts, starts, lengths = [], [], [], []
        for end, size in zip(block.ends.tolist(), block.sizes.tolist(), strict=True):
            own = gone[end - size : end]
            s, k = runs(own)
            counts.append(int(k.sum()))
            starts.append(s)
            lengths.append(k)
            kept.append(raw[end - size : end][~own].tobytes() if len(s) else block.data[end - size : end])
        out = pa.table({
            "doc": block.rows.column("doc"), "text": pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()),
            **{c: block.rows.column(c) for c in names},
            "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(counts, pa.int64()),
            "span_starts": pa.array(starts, pa.list_(pa.int64())), "span_lengths": pa.array(lengths, pa.list_(pa.int64())),
        })
        del block, raw, kept, starts, lengths
        give_back()
        return out

    first = blocks.map(digits, ENTRIES).groupBy("bucket").applyInArrow(judge, REPLIES)
    second = blocks.map_with(first, depth, ENTRIES).groupBy("bucket").applyInArrow(in_earlier_block(2), REPLIES)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, t) for c, t in blocks.fields.items()]])
    schema = schema.add("kept", T.BinaryType())
    for c in ("n_bytes", "n_removed"):
        schema = schema.add(c, T.LongType())
    for c in ("span_starts", "span_lengths"):
        schema = schema.add(c, T.ArrayType(T.LongType()))
    out = blocks.map_with(first.union(second), finish, schema)
    back = {"doc": id_col, "text": text_col, **dict(zip(blocks.fields, blocks.carried, strict=True))}
    return out.toDF(*[back.get(c, c) for c in out.columns])
