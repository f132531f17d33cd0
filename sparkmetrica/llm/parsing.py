"""Document fingerprints by locally consistent parsing.

A text is a string of symbols (code points). On each level runs of one symbol become one symbol; then deterministic coin
tossing, each symbol's lowest bit that differs from its left neighbour repeated four times, gives small labels of which no two
neighbours are equal; phrases begin at local maxima of the labels and are named by a hash of their
symbols; the names are the next level's symbols. Where phrases begin depends on a few neighbours only,
so equal substrings get equal names inside, wherever they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.llm.blocks import Cuts, ordered
from sparkmetrica.llm.common import U, mix

PLACES = 64  # minima kept in a fingerprint
LEVEL = 2  # phrases of this level and above are sampled
CHUNK = 1 << 19  # symbols parsed at once; a longer text is parsed alone
EMPTY = 0xFFFF


def toss(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Twice the lowest bit position in which a symbol differs from its left neighbour, plus that bit of it."""
    low = np.empty_like(x)
    low[1:] = x[1:] ^ x[:-1]
    low[head] = 1
    low &= ~low + U(1)
    return (np.bitwise_count(low - U(1)).astype(np.uint64) << U(1)) | ((x & low) != 0)


def parse_level(names: np.ndarray, seg: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and the text each belongs to."""
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (seg[1:] != seg[:-1])])
    run = np.diff(np.r_[first, len(names)]).astype(np.uint64)
    names, seg = names[first], seg[first]
    names = np.where(run > 1, mix(names + run * U(0x9E3779B97F4A7C15)), names)
    head = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    label = names
    for _ in range(4):
        label = toss(label, head)
    small = label.astype(np.int8)
    peak = np.zeros(len(names), bool)
    peak[1:-1] = (small[1:-1] > small[:-2]) & (small[1:-1] > small[2:])
    peak[head[1:] - 1] = False  # the last symbol of a text begins no phrase
    peak[np.minimum(head + 1, len(peak) - 1)] = False  # nor does the second
    peak[head] = True
    start = np.flatnonzero(peak)
    size = np.diff(np.r_[start, len(names)])
    inside = (np.arange(len(names)) - np.repeat(start, size)).astype(np.uint64)
    total = np.add.reduceat(mix(names + (inside + U(1)) * U(0xC2B2AE3D27D4EB4F)), start)
    return mix(total + U(level * 0x165667B19E3779F9 % 2**64) + size.astype(np.uint64)), seg[start]


def fingerprints(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Sampled minima, one row of ``PLACES`` 16-bit values per text, and the name of the whole text."""
    out = np.full((len(texts), PLACES), EMPTY, np.uint16)
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= CHUNK):
            total += len(texts[upto])
            upto += 1
        out[at:upto] = sample(texts[at:upto])
        at = upto
    return out, [xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]


def sample(texts: list[str]) -> np.ndarray:
    least = np.full(len(texts) * PLACES, np.iinfo(np.uint64).max, np.uint64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names = code.astype(np.uint64) + U(1)
    seg = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    level = 0
    while len(names):
        level += 1
        names, seg = parse_level(names, seg, level)
        single = np.r_[True, seg[1:] != seg[:-1]] & np.r_[seg[1:] != seg[:-1], True]
        use = slice(None) if level >= LEVEL else single
        np.minimum.at(least, seg[use] * PLACES + (names[use] & U(PLACES - 1)).astype(np.int64), names[use] >> U(6))
        names, seg = names[~single], seg[~single]
    found = (least & U(0xFFFF)).astype(np.uint16)
    found[(found == EMPTY) & (least != np.iinfo(np.uint64).max)] = 0
    found[least == np.iinfo(np.uint64).max] = EMPTY
    return found.reshape(-1, PLACES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the places filled in either that are equal: estimates the Jaccard similarity of the phrases; 1 for two empty texts."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(axis=-1)
    return np.where(n > 0, ((a == b) & used).sum(axis=-1) / np.maximum(n, 1), 1.0)


def as_text(places: np.ndarray, whole: list[str]) -> list[str]:
    """The fingerprint as text: name of the whole text, then four hexadecimal digits for each place."""
    big = places.astype(">u2")
    return [f"{w}{row.tobytes().hex()}" for w, row in zip(whole, big, strict=True)]


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint)`` for every row of ``docs``, without any shuffle; NULL text is empty."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(as_text(*fingerprints(texts)))], ["id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_chars long, fingerprint string")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The next document is the one with the next id (of equal ids by text; NULL ids first), after the last the first. The
    edited text ends with the beginning of the next document in place of its last quarter.
    Columns: ``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Each block of documents gets the first document of the next block as well, so the texts are shuffled once.
    """
    cuts = Cuts(docs, id_col, text_col)
    rows = docs.select(cuts.of(F.col(id_col)).alias("block"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    smallest = F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc"))
    heads = sorted((b, h["doc"]) for b, h in rows.groupBy("block").agg(smallest).collect())
    follows = dict(zip([h[1] for h in heads], [heads[i - 1][0] for i in range(len(heads))], strict=True))
    ids = np.array(sorted(k for k in follows if k is not None), np.int64)
    into = np.array([follows[k] for k in ids.tolist()], np.int64)
    null_into = follows.get(None)

    def target(found: pa.Array) -> pa.Array:
        x = found.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
        null = found.is_null().to_numpy(zero_copy_only=False)
        hit = (ids[at] == x) & ~null if len(ids) else np.zeros(len(x), bool)
        to = np.where(hit, into[at] if len(ids) else 0, 0 if null_into is None else null_into)
        return pa.array(to, mask=~(hit | (null if null_into is not None else False)))

    moved = docs.select(F.arrow_udf(target, "long")(F.col(id_col).cast("long")).alias("block"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("block IS NOT NULL")
    both = rows.withColumn("next", F.lit(False)).unionByName(moved.withColumn("next", F.lit(True)))

    def run(key, block):
        own = ordered(block.filter(pa.compute.invert(block.column("next"))))
        after = ordered(block.filter(block.column("next"))).slice(0, 1)
        texts = [t or "" for t in own.column("text").to_pylist()]
        chain = [*texts[1:], *(t or "" for t in after.column("text").to_pylist())]
        changed = [edited(t, f) for t, f in zip(texts, chain, strict=True)]
        places, whole = fingerprints([*texts, chain[-1]])
        places_e, whole_e = fingerprints(changed)
        return pa.table({
            "doc": own.column("doc"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            "fingerprint": pa.array(as_text(places[:-1], whole[:-1])), "edited_fingerprint": pa.array(as_text(places_e, whole_e)),
            "near_edited": pa.array(likeness(places[:-1], places_e)), "near_next": pa.array(likeness(places[:-1], places[1:])),
        })

    return both.groupBy("block").applyInArrow(
        run, "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
