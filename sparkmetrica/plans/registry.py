"""Registry of the queries the driver runs, with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, columns, digits: int) -> DataFrame:
    """Doubles rounded, with -0.0 turned into 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def query(name: str, oracle: str | None = None, floats: str = "", digits: int = 6):
    """Registers ``f(spark, folder) -> DataFrame``.

    ``floats`` names the DOUBLE columns that both engines round to ``digits``,
    since the order of summation changes the last bits.
    """
    names = floats.split()

    def register(f):
        def run(spark, folder):
            return rounded(f(spark, folder), names, digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            replaced = ", ".join(f"round(({c})::double, {digits}) + 0.0 AS {c}" for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({oracle}) AS answer" if names else oracle
        return f

    return register


def sql_uniform(key: str, seed: str, part: int = 0) -> str:
    """SQL text of the hash-based uniform number."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), {1 + 8 * part}, 8))::bigint::double / 4294967296.0)"


# Tail probabilities for the oracles, by Simpson's rule on the textbook densities.
# They share nothing with the continued fractions the library uses.
_STEPS = 2000


def _simpson(width: str, density: str) -> str:
    """Integral of ``density`` (in terms of ``s``) from 0 to ``width``."""
    weight = f"(CASE WHEN k = 0 OR k = {_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    body = density.replace("{s}", f"(k * ({width}) / {_STEPS}.0::double)")
    return f"(({width}) / {3 * _STEPS}.0::double * list_sum(list_transform(range(0, {_STEPS + 1}), lambda k: {weight} * ({body}))))"


def sql_p_norm(z: str) -> str:
    return f"(1 - 2 * {_simpson(f'abs({z})', 'exp(-0.5 * {s} * {s}) / sqrt(2 * pi())')})"


def sql_p_t(t: str, v: str) -> str:
    scale = f"exp(lgamma((({v}) + 1) / 2.0::double) - lgamma(({v}) / 2.0::double)) / sqrt(({v}) * pi())"
    shape = "exp(-((" + v + ") + 1) / 2.0::double * ln(1 + {s} * {s} / (" + v + ")))"
    return f"(1 - 2 * {scale} * {_simpson(f'abs({t})', shape)})"


def sql_p_chi2(x: str, k: str) -> str:
    """The square root of a chi-square variable has a density without a pole."""
    scale = f"2 / exp(({k}) / 2.0::double * ln(2) + lgamma(({k}) / 2.0::double))"
    shape = "pow({s}, (" + k + ") - 1) * exp(-{s} * {s} / 2)"
    return f"(1 - {scale} * {_simpson(f'sqrt({x})', shape)})"


def sql_p_f(f: str, d1: str, d2: str) -> str:
    a, b = f"(({d1}) / 2.0::double)", f"(({d2}) / 2.0::double)"
    width = f"sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    scale = f"2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    shape = "pow({s}, 2 * " + a + " - 1) * pow(1 - {s} * {s}, " + b + " - 1)"
    return f"(1 - {scale} * {_simpson(width, shape)})"
