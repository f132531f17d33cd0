"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into groups of bounded size. Each group is evolved on several
islands, each a task of its own with its own random numbers: a solution is a grouping of pieces into
sequences, crossover injects whole well-filled sequences of one parent into the other,
removes the sequences that hold duplicates, and best-fits the displaced pieces in falling
length. Between epochs the best solution of each island migrates to the next island of
its ring. The best island's solution is the group's packing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.llm.common import give_back, per_batch
from sparkmetrica.llm.tokens import encoder, token_path
from sparkmetrica.session import settle

CAPACITY = 2048
GROUP = 8192  # pieces in a group on average
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 4
TEXTS = 2048  # texts encoded at once


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: as few as possible, all full but the first."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str | None) -> DataFrame:
    """``(doc, piece, start, length, crc, salt)`` for every piece of every row; NULL text is empty, which is one id."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("salt", pa.int64())])

    def run(batches):
        code = encoder(path or token_path())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = []
                ids = code.encode(part.column("text").to_pylist())
                for i, (doc, data) in enumerate(zip(part.column("doc").to_pylist(), ids, strict=True)):
                    data += end
                    for k, (s, n) in enumerate(piece_bounds(len(data) // 4, capacity)):
                        rows.append((doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), at + i))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, piece int, start long, length long, crc long, salt long")


class Bins:
    """Sequences under construction, found by the room they have left."""

    def __init__(self, capacity: int, room: list[int]):
        self.room = room
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        for b, r in enumerate(room):
            self.put(b, r)

    def put(self, b: int, r: int) -> None:
        if r:
            self.by_room[r].append(b)
            self.open |= 1 << r

    def fit(self, length: int) -> int:
        """Best fit: the sequence with the least room that is enough, or a new one."""
        left = self.open >> length
        if left:
            r = length + (left & -left).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.open ^= 1 << r
            self.room[b] = r - length
        else:
            b, r = len(self.room), self.capacity
            self.room.append(r - length)
        self.put(b, r - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, at: np.ndarray, room: list[int]) -> np.ndarray:
    """Puts the pieces of ``order`` into the sequences with ``room``; changes and answers ``at``."""
    bins = Bins(capacity, room)
    at[order] = [bins.fit(n) for n in lengths[order].tolist()]
    return at


def compact(at: np.ndarray) -> np.ndarray:
    return np.unique(at, return_inverse=True)[1]


def fitness(lengths: np.ndarray, at: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the fuller ones: to be made small."""
    fill = np.bincount(at, lengths)
    return len(fill), -float(((fill / capacity) ** 2).mean())


def cross(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``a`` with whole well-filled sequences of ``b``."""
    fill = np.bincount(b, lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(good, max(1, len(good) // 4), replace=False)
    injected = np.isin(b, chosen)
    hurt = np.zeros(int(a.max()) + 1, bool)
    hurt[a[injected]] = True
    displaced = hurt[a] & ~injected
    kept = ~hurt[a] & ~injected
    child = np.full(len(lengths), -1, np.int64)
    child[kept] = compact(a[kept]) if kept.any() else 0
    n = int(child.max()) + 1
    child[injected] = n + compact(b[injected])
    room = (capacity - np.bincount(child[child >= 0], lengths[child >= 0])).astype(np.int64).tolist()
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-(lengths[order] * rng.uniform(0.9, 1.1, len(order))), kind="stable")]
    return compact(best_fit(lengths, order, capacity, child, room))


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """Best solution after ``GENERATIONS``, starting from ``elites`` and best-fit solutions with random order."""
    full = lengths >= capacity
    if full.any():
        rest = np.flatnonzero(~full)
        at = np.empty(len(lengths), np.int64)
        inner = evolve(lengths[rest], [compact(e[rest]) for e in elites], seed, capacity) if len(rest) else np.zeros(0, np.int64)
        at[rest] = inner
        at[full] = (int(inner.max()) + 1 if len(rest) else 0) + np.arange(int(full.sum()))
        return at
    rng = np.random.default_rng(seed)
    least = math.ceil(int(lengths.sum()) / capacity)
    people = [compact(e) for e in elites]
    while len(people) < POPULATION:
        spread = 0.0 if not people else 0.15
        order = np.argsort(-(lengths * rng.uniform(1 - spread, 1 + spread, len(lengths))), kind="stable")
        people.append(compact(best_fit(lengths, order, capacity, np.empty(len(lengths), np.int64), [])))
    ranked = sorted(people, key=lambda p: fitness(lengths, p, capacity))
    for _ in range(GENERATIONS):
        if int(ranked[0].max()) + 1 == least:
            break
        born = [cross(lengths, ranked[i], ranked[j], capacity, rng) for i, j in ((0, 1), (1, 0), (0, 2), (2, 3))]
        ranked = sorted([*ranked, *born], key=lambda p: fitness(lengths, p, capacity))[:POPULATION]
    return ranked[0]


STATE = "group long, island int, n int, pieces binary, lengths binary, best binary, bins int"


def state_row(group: int, island: int, pieces: np.ndarray, lengths: np.ndarray, best: np.ndarray) -> pa.Table:
    return pa.table({
        "group": pa.array([group], pa.int64()), "island": pa.array([island], pa.int32()), "n": pa.array([len(lengths)], pa.int32()),
        "pieces": pa.array([pieces.tobytes()], pa.binary()), "lengths": pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
        "best": pa.array([best.astype("<i4").tobytes()], pa.binary()), "bins": pa.array([int(best.max()) + 1], pa.int32()),
    })


KEY = np.dtype([("doc", "<i8"), ("null", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    path: str | None = None, group_size: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS,
) -> DataFrame:
    """``(doc, piece, start, length, crc, sequence, place)``: where each piece of each document goes.

    Every row of ``docs`` is its ids and ``end_id``. Documents above ``capacity`` ids are cut, the first piece may be
    shorter than it. NULL text counts as empty; a NULL id is kept; repeated rows are packed as
    often as they occur. Sequences are filled without gaps from place 0 and never hold more than ``capacity``.
    """
    pieces = settle(token_pieces(docs, id_col, text_col, capacity, end_id, path))
    groups = max(1, math.ceil(pieces.count() / group_size))

    def begin(key, rows):
        rows = rows.sort_by([("doc", "ascending"), ("piece", "ascending"), ("crc", "ascending"), ("salt", "ascending")])
        made = np.zeros(rows.num_rows, KEY)
        doc = rows.column("doc").combine_chunks()
        made["doc"], made["null"] = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
        for c in ("piece", "start", "length", "crc"):
            made[c] = rows.column(c).to_numpy()
        group, island = key[0].as_py(), key[1].as_py()
        lengths = made["length"].astype(np.int64)
        return state_row(group, island, made, lengths, evolve(lengths, [], 1000 * group + island, capacity))

    def go_on(key, rows):
        group, island = key[0].as_py(), key[1].as_py()
        pieces = np.frombuffer(rows.column("pieces")[0].as_py(), KEY)
        lengths = np.frombuffer(rows.column("lengths")[0].as_py(), "<i4").astype(np.int64)
        met = sorted(zip(rows.column("island").to_pylist(), rows.column("best").to_pylist(), strict=True))
        elites = [np.frombuffer(b, "<i4").astype(np.int64) for _, b in met]
        return state_row(group, island, pieces, lengths, evolve(lengths, elites, 1_000_003 * group + island + 17, capacity))

    def unroll(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for group, pieces, best in zip(*(batch.column(c).to_pylist() for c in ("group", "pieces", "best")), strict=True):
            p, at = np.frombuffer(pieces, KEY), np.frombuffer(best, "<i4").astype(np.int64)
            order = np.argsort(at, kind="stable")
            lengths, at = p["length"][order], at[order]
            before = np.cumsum(lengths) - lengths
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = before - np.repeat(before[head], np.diff([*head, len(at)]))
            p = p[order]
            columns = [pa.array(p["doc"], mask=p["null"]), *(pa.array(p[c]) for c in ("piece", "start", "length", "crc")), pa.array((group << 32) + at), pa.array(place)]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "crc", "sequence", "place"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    dealt = F.pmod(F.xxhash64("doc", "piece", "crc", "salt"), F.lit(groups)).alias("group")
    each = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
    state = pieces.select(dealt, "*").select("*", each).groupBy("group", "island").applyInArrow(begin, STATE)
    for _ in range(epochs - 1):
        moves = F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands))))).alias("to")
        met = settle(state).select("*", moves)
        state = met.groupBy("group", "to").applyInArrow(go_on, STATE)
    state = settle(state)
    best = state.groupBy("group").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return state.join(best, ["group", "island"]).select("group", "pieces", "best").mapInArrow(
        per_batch(unroll), "doc long, piece int, start long, length long, crc long, sequence long, place long"
    )
