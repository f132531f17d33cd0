"""Permutations of row numbers that are computed, not sorted.

A Feistel network on a grid of about sqrt(n) by sqrt(n) cells is a bijection of the cells whatever its round function is; a place that falls
outside the n rows is sent on until it falls inside (cycle walking), which keeps it a bijection of the rows. So one order of the
rows serves any number of permutations: each is an expression of the row's place.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform
from sparkmetrica.operators import order as O

ROUNDS = 4
WALKS = 16


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest grid with about equal sides that has ``n`` cells."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) if n else 1


def round_values(seed: str, turn: int, side: int) -> Column:
    """First 8 hex digits of ``md5(seed:turn:half)`` for every half below ``side``: one literal array of about the square root of the rows."""
    values = [int(hashlib.md5(f"{seed}:{turn}:{half}".encode()).hexdigest()[:8], 16) for half in range(side)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scrambled(place: Column, a: int, b: int, tables: list[Column]) -> Column:
    """One pass through the network; ``place`` and the answer are cells from 0 to ``a * b - 1``."""
    left, right = F.pmod(place, F.lit(a)).cast("bigint"), F.floor(place / F.lit(a)).cast("bigint")
    for turn, values in enumerate(tables):
        if turn % 2 == 0:
            left = F.pmod(left + F.get(values, right.cast("int")), F.lit(a)).cast("bigint")
        else:
            right = F.pmod(right + F.get(values, left.cast("int")), F.lit(b)).cast("bigint")
    return right * F.lit(a) + left


def permuted(place: Column, n: int, seed: str) -> Column:
    """Where the row at ``place`` (from 0) goes in a permutation of ``n`` rows.

    There are fewer cells outside than rows on a side, so a walk through ``WALKS`` of them has a chance below n to the power -8; it would be an error, never a wrong place.
    """
    a, b = grid(n)
    tables = [round_values(seed, turn, a if turn % 2 else b) for turn in range(ROUNDS)]
    first, outside = scrambled(place, a, b, tables), a * b - n
    if not outside:
        return first
    walk = lambda x, _: F.when(x >= n, scrambled(x, a, b, tables)).otherwise(x)
    at = F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, WALKS))), first, walk)
    if outside > WALKS:
        at = F.when(at < n, at).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("bigint"))
    return F.when(first < n, first).otherwise(at)  # few rows walk


def shuffled_columns(df: DataFrame, columns, key, seed: str, keep=()) -> DataFrame:
    """``place``, the columns in ``keep`` and ``columns`` as they are, and for each column ``c`` of these a permuted ``<c>_new``.

    The rows are put in order once (by a hash of ``key``, which must be unique); values of all columns travel to their new places in one exchange.
    """
    columns, keep = list(columns), list(keep)
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    placed = O.positions(df.withColumn("_u", hash_uniform(keys, seed)), [F.col("_u"), *[F.col(k) for k in keys]])
    n = df.count()
    at = (F.col("pos") - 1).cast("bigint")
    rest = list(dict.fromkeys([*keep, *columns]))
    # flat columns, so that values of fixed width are gathered by hash and not sorted
    empty = {c: F.lit(None).cast(df.schema[c].dataType) for c in rest}

    def entry(target: Column, values: dict, own: dict) -> Column:
        cells = [values.get(c, empty[c]).alias(f"v{i}") for i, c in enumerate(columns)]
        return F.struct(target.alias("place"), *cells, *[own.get(c, empty[c]).alias(f"c{i}") for i, c in enumerate(rest)])

    placed = placed.select(at.alias("_at"), *[permuted(at, n, f"{seed}:{c}").alias(f"_to{i}") for i, c in enumerate(columns)], *rest)
    home = entry(F.col("_at"), {}, {c: F.col(c) for c in rest})
    sent = [entry(F.col(f"_to{i}"), {c: F.col(c)}, {}) for i, c in enumerate(columns)]
    long = placed.select(F.inline(F.array(home, *sent)))
    # a place has one value of each column, all others are NULL
    met = long.groupBy("place").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(rest))], *[F.max(f"v{i}").alias(f"n{i}") for i in range(len(columns))])
    return met.select("place", *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(f"n{i}").alias(f"{c}_new") for i, c in enumerate(columns)])
