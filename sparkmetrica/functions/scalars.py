"""Small column helpers used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: str | Column) -> Column:
    """``c`` as DOUBLE with NaN turned into NULL, the library's missing value."""
    return F.nullif(col(c).cast("double"), F.lit(float("nan")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column of ``df``."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in floating})


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as DOUBLE; NULL where ``b`` is zero (ANSI division would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def hash_uniform(key, seed: str, part: int = 0) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``key`` alone.

    First 8 hex digits of ``md5(seed:key)`` over 2^32: the same on every run,
    every partitioning and in any SQL engine. ``key`` may be a list of columns.
    ``part`` 0 to 3 takes another 8 of the 32 digits: four numbers for one hash.
    """
    keys = key if isinstance(key, (list, tuple)) else [key]
    text = F.concat_ws(":", F.lit(seed), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("double") / F.lit(4294967296.0)
