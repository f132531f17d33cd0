"""Helpers shared by the text operators: words, Arrow columns, row sizes, registry."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``f(spark, folder) -> DataFrame`` under ``name``."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def bound_batches(spark, size: int = 8 << 20) -> None:
    """Arrow batches of 8 MB: the default of 64 MB is held in the JVM and in Python for every task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; NULL has none.

    ``bytes.split`` cuts at exactly these six characters and ``bytes.lower`` changes A-Z only.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def give_back() -> None:
    """Returns freed memory to the system. Arrow's pool and the C library keep it otherwise, and a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """``mapInArrow`` function that turns each batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield out
        batch = out = None
        give_back()

    return run


U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit names, so that any of their bits may be used."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    h ^= h >> U(32)
    return h


def rolling(names: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of every ``length`` consecutive entries, by doubling.

    Entry ``i`` of the answer names ``names[i : i + length]``; the answer is
    ``length - 1`` shorter than the input.
    """
    n = len(names)
    if n < length:
        return np.zeros(0, np.uint64)
    piece, size, out, done = names, 1, None, 0
    while True:
        if length & size:
            left = n - done - size + 1
            out = piece if out is None else joined(out[:left], piece[done : done + left], 0x9E3779B97F4A7C15)
            done += size
        if done == length:
            return mix(out)
        piece = joined(piece[:-size], piece[size:], 0xC2B2AE3D27D4EB4F + 2 * size)
        size *= 2


def joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    h = a * U(by)
    h += b
    h ^= h >> U(29)
    return h


def hash_fraction(column: str, seed: int = 7):
    """A number in [0, 1) from a hash of a column; NULL counts as a value."""
    h = F.xxhash64(F.col(column), F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)
