"""Table preparation and exploratory summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmetrica.functions.scalars import nan_to_null, num, ratio
from sparkmetrica.operators import order as O
from sparkmetrica.operators.order import exact_quantiles, join_back, ordered_counts
from sparkmetrica.session import settle


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _flat(row: DataFrame, columns: dict, first: str) -> DataFrame:
    """One wide row to one row per entry of ``columns`` (``label -> {name: Column}``)."""
    entries = [
        F.struct(F.lit(label).alias(first), *[c.alias(n) for n, c in values.items()])
        for label, values in columns.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def profile(df: DataFrame, columns=None, exact: bool = False) -> DataFrame:
    """One row per column: counts, missing share, distinct, range, moments.

    One aggregation for the numeric columns and one for the others: a minimum of
    text would take the sort-based plan, and slow the numeric ones down with it.
    Neither reads a column of the other. ``distinct`` is approximate unless
    ``exact``, see :func:`distinct_counts`. Moments are NULL
    for columns that are not numeric.
    """
    columns = list(columns or df.columns)
    clean = nan_to_null(df.select(*columns))
    kinds = [[c for c in columns if _is_numeric(df, c) == numeric] for numeric in (True, False)]
    out = O.union_all([_profile(clean, names) for names in kinds if names])
    if not exact:
        return out
    rows = settle(out)  # a row for each column
    about = {r["column"]: r["distinct"] for r in rows.select("column", "distinct").collect()}
    counts = distinct_counts(clean, columns, about).withColumnRenamed("distinct", "_exact")
    joined = rows.join(F.broadcast(counts), "column")  # a row for each column
    return joined.withColumn("distinct", F.col("_exact")).select(*out.columns)


def _profile(clean: DataFrame, columns) -> DataFrame:
    aggs, shaped = [F.count(F.lit(1)).alias("_n")], {}
    for i, c in enumerate(columns):
        numeric = _is_numeric(clean, c)
        value = F.col(c).cast("double")
        parts = {"count": F.count(c), "min": F.min(c).cast("string"), "max": F.max(c).cast("string"), "distinct": F.approx_count_distinct(c)}
        moments = {"mean": F.avg, "sd": F.stddev_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}
        if numeric:
            parts |= {n: f(value) for n, f in moments.items()}
        aggs += [e.alias(f"_{i}_{n}") for n, e in parts.items()]
        got = {n: F.lit(None).cast("double") for n in moments} | {n: F.col(f"_{i}_{n}") for n in parts}
        missing = F.col("_n") - got["count"]
        shaped[c] = {
            "count": got["count"],
            "missing": missing,
            "missing_share": ratio(missing, F.col("_n")),
            **{n: got[n] for n in ("distinct", "min", "max", *moments)},
        }
    return _flat(clean.agg(*aggs), shaped, "column")


#: Values a bitmap may span for each distinct one: a bit against the 16 bytes of a value in a hash table.
SPARSE = 128


def _ordinal(df: DataFrame, c: str) -> Column | None:
    """Integers and dates as numbers that a bitmap can hold."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(c).cast("bigint")
    return F.unix_date(F.col(c)).cast("bigint") if isinstance(kind, T.DateType) else None


def _identity(df: DataFrame, c: str) -> dict:
    """A value under ``number``, ``whole`` or ``text`` that is equal for equal values only; numbers are not spelt out."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return {"number": F.col(c).cast("double")}  # grouping takes the two zeros for one
    if (ordinal := _ordinal(df, c)) is not None:
        return {"whole": ordinal}
    if isinstance(kind, T.BinaryType):
        return {"text": F.hex(c)}
    return {"text": F.to_json(F.struct(c)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.col(c).cast("string")}


def distinct_counts(df: DataFrame, columns=None, about: dict | None = None) -> DataFrame:
    """``column, distinct``: exact counts of the values of many columns, from two scans at most that share no column.

    Integers and dates that lie close are bits: every task makes one bitmap for 32 768 neighbouring values, and bitmaps are what travels.
    All other columns go in the long form (column, value), equal values of a task made one before the shuffle. ``about`` has
    approximate counts of distinct values, taken here where missing; they choose the form, never the answer.
    """
    columns = list(columns or df.columns)
    ordinals = {c: o for c in columns if (o := _ordinal(df, c)) is not None}
    dense, least = [], {}
    if ordinals:
        aggs = [f(o).alias(f"{n}{i}") for i, o in enumerate(ordinals.values()) for n, f in (("l", F.min), ("h", F.max))]
        aggs += [F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(ordinals) if c not in (about or {})]
        got = df.agg(*aggs).first().asDict()
        for i, c in enumerate(ordinals):
            low, high, n = got[f"l{i}"], got[f"h{i}"], (about or {}).get(c, got.get(f"n{i}"))
            if low is not None and -(1 << 62) < low and high - low < SPARSE * max(n, 1):
                dense.append(c)
                least[c] = low
    parts = []
    if dense:
        place = {c: ordinals[c] - F.lit(least[c]) + 1 for c in dense}
        entries = [F.struct(F.lit(columns.index(c)).alias("i"), F.bitmap_bucket_number(v).alias("bucket"), F.bitmap_bit_position(v).alias("bit")) for c, v in place.items()]
        bits = df.select(F.inline(F.array(*entries))).where("bit IS NOT NULL").groupBy("i", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        parts.append(bits.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("distinct")))
    rest = [c for c in columns if c not in dense]
    if rest:
        kinds = {"number": "double", "whole": "bigint", "text": "string"}
        entries = [
            F.struct(F.lit(columns.index(c)).alias("i"), F.col(c).isNotNull().alias("there"), *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
            for c in rest
            for own in [_identity(df, c)]
        ]
        values = df.select(F.inline(F.array(*entries))).where("there").groupBy("i", *kinds).agg(F.lit(1))
        parts.append(values.groupBy("i").agg(F.count("i").alias("distinct")))
    found = {r["i"]: r["distinct"] for r in O.union_all(parts).collect()}  # a row for each column
    return df.sparkSession.createDataFrame([(c, found.get(i, 0)) for i, c in enumerate(columns)], "column string, distinct bigint")


def quantiles(df: DataFrame, columns, probs=(0.25, 0.5, 0.75), exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles of several numeric columns, one row per column."""
    columns = list(columns)
    if exact:
        entries = [F.struct(F.lit(c).alias("column"), num(c).alias("value")) for c in columns]
        return exact_quantiles(df.select(F.inline(F.array(*entries))), "value", probs, ["column"])
    aggs = [
        F.percentile_approx(num(c), [float(p) for p in probs], accuracy).alias(f"_{i}")
        for i, c in enumerate(columns)
    ] + [F.count(num(c)).alias(f"_n{i}") for i, c in enumerate(columns)]
    shaped = {
        c: {"n": F.col(f"_n{i}"), **{O.quantile_name(p): F.col(f"_{i}")[k] for k, p in enumerate(probs)}}
        for i, c in enumerate(columns)
    }
    return _flat(df.agg(*aggs), shaped, "column")


KLL_K = 800


def kll_error(k: int = KLL_K) -> float:
    """Share of the rows by which a rank from a KLL sketch of size ``k`` may be off, with a confidence of 99 %."""
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, column: str, by=(), k: int = KLL_K) -> DataFrame:
    """``by..., n, min, max, sketch``: mergeable sketches of a column, to be saved and merged with others later.

    A sketch has some kilobytes whatever the rows behind it, so a table of them by day and group answers for any
    range of days without reading the rows again. ``n``, ``min`` and ``max`` are exact. Missing values have no part.
    """
    value = num(column)
    rows = df.select(*by, value.alias("_v"))
    return rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """The sketches of :func:`quantile_sketches` merged into one for each ``by``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Sketch replaced by quantiles ``q25``, ``q50``..; NULL where no value was seen."""
    found = {O.quantile_name(p): F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))) for p in probs}
    return sketches.withColumns(found).drop("sketch")


def _metrics(metrics: dict) -> list[Column]:
    return [c.alias(name) for name, c in metrics.items()]


def group_summary(df: DataFrame, keys, metrics: dict) -> DataFrame:
    """``metrics`` maps an output name to an aggregate column."""
    return df.groupBy(*keys).agg(*_metrics(metrics))


def subtotals(df: DataFrame, keys, metrics: dict, kind: str = "rollup") -> DataFrame:
    """Subtotals over key sets; ``level`` tells rolled-up keys from NULL keys.

    ``kind`` is ``rollup``, ``cube`` or ``sets`` with ``keys`` a list of key lists.
    """
    if kind == "sets":
        flat = list(dict.fromkeys(k for s in keys for k in s))
        grouped = df.groupingSets([[F.col(k) for k in s] for s in keys], *[F.col(k) for k in flat])
    else:
        grouped = df.rollup(*keys) if kind == "rollup" else df.cube(*keys)
    return grouped.agg(F.grouping_id().alias("level"), *_metrics(metrics))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Frequency and share of each value; the ``k`` most frequent if ``k`` is given.

    The share is of all rows. The first row is the mode (ties: smaller value).
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = counts.withColumn("share", F.col("n") / total)
    return counts if k is None else counts.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def crosstab(df: DataFrame, a: str, b: str, agg: Column, values=None) -> DataFrame:
    """Pivot of ``a`` by ``b``; pass ``values`` to save a job that looks for them."""
    return df.groupBy(a).pivot(b, values).agg(agg)


def melt(df: DataFrame, ids, values, variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    return df.join(dim, on, how)


def concat(frames) -> DataFrame:
    """Stack tables by column name; absent columns become NULL."""
    return O.union_all(frames)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the range: ``bin, lo, hi, n``; the last bin is closed."""
    value = num(column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        "n",
    )


def box_stats(df: DataFrame, by, column: str, k: float = 1.5) -> DataFrame:
    """Box-plot table per group: quartiles, whiskers at the last value inside the
    fences, and the number of points outside them."""
    by = [by] if isinstance(by, str) else list(by)
    counts = ordered_counts(df, column, by)
    quartiles = O.quantiles_of(counts, (0.25, 0.5, 0.75), by)
    spread = F.lit(float(k)) * (F.col("q75") - F.col("q25"))
    fences = quartiles.withColumns({"_lo": F.col("q25") - spread, "_hi": F.col("q75") + spread})
    inside = F.col("value").between(F.col("_lo"), F.col("_hi"))
    joined = join_back(counts, fences.withColumnRenamed("n", "_size"), by, "_size")
    return joined.groupBy(*by).agg(
        F.max("_size").alias("n"),
        *[F.max(q).alias(q) for q in ("q25", "q50", "q75")],
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def correlations(df: DataFrame, columns, kind: str = "pearson") -> DataFrame:
    """Correlation of every pair of columns as ``(a, b, r)``, one aggregate job.

    ``spearman`` ranks the rows that are complete in all the columns first.
    """
    columns = list(columns)
    rows = df.select(*[num(c).alias(c) for c in columns])
    if kind == "spearman":
        rows = O.all_ranks(rows.dropna(), columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = rows.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    found = {pair: F.col(f"_{i}") for i, pair in enumerate(pairs)}
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), found.get((a, b), found.get((b, a))).alias("r"))
        for a in columns
        for b in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside ``[q25 - k iqr, q75 + k iqr]`` with exact quartiles."""
    q = exact_quantiles(df, column, (0.25, 0.75)).first()
    if q["q25"] is None:  # no value, no outlier
        return df.where(F.lit(False))
    spread = k * (q["q75"] - q["q25"])
    return df.where(~num(column).between(q["q25"] - spread, q["q75"] + spread))


def winsorize(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values clipped to two exact quantiles."""
    q = exact_quantiles(df, column, (lo, hi)).first()
    low, high = q[O.quantile_name(lo)], q[O.quantile_name(hi)]
    value = num(column)
    clipped = F.when(value < F.lit(low), F.lit(low)).when(value > F.lit(high), F.lit(high)).otherwise(value)
    return df.withColumn(column, clipped)


def fill_missing(df: DataFrame, column: str, how="mean", by=None) -> DataFrame:
    """Fill NULL and NaN with a constant, the mean or the median, overall or per group.

    ``how='drop'`` removes the rows instead. Groups without any value stay NULL.
    """
    value = num(column) if _is_numeric(df, column) else F.col(column)
    if how == "drop":
        return df.where(value.isNotNull())
    if how not in ("mean", "median"):
        return df.withColumn(column, F.coalesce(value, F.lit(how)))
    by = [by] if isinstance(by, str) else list(by or [])
    if how == "mean":
        stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(num(column)).alias("_fill"))
    else:
        stats = exact_quantiles(df, column, (0.5,), by).withColumnsRenamed({"n": "_n", "q50": "_fill"})
    if not by:
        return df.withColumn(column, F.coalesce(value, F.lit(stats.first()["_fill"])))
    filled = join_back(df, stats, by, "_n")
    return filled.withColumn(column, F.coalesce(value, F.col("_fill"))).select(*df.columns)


def dedupe(df: DataFrame, keys=None, order=None) -> DataFrame:
    """Exact duplicates, or one row per key: the one with the largest ``order``.

    ``order`` should end with a tie-breaker. The winner is a ``max_by``
    aggregate, so the copies of a hot key are reduced before the shuffle.
    """
    if keys is None:
        return df.distinct()
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(rest or keys))
    best = F.max_by(row, F.struct(*order)) if order else F.max(row)
    # keys come from the grouping, so a later join on them needs no other shuffle
    kept = {c: F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns}
    return df.groupBy(*keys).agg(best.alias("_row")).select(*kept.values())


def topk(df: DataFrame, by, order, k: int, method: str = "row_number") -> DataFrame:
    """First ``k`` rows overall (``by`` empty) or per group, with their rank.

    Spark limits each group on the map side before the shuffle, so a hot group
    sends at most k rows (k ranks) per task.
    """
    by = list(by or [])
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    if not by and method == "row_number":
        df = df.orderBy(*order).limit(k)
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn("rank", fn().over(window)).where(F.col("rank") <= k)


def add_group_share(df: DataFrame, by, column: str) -> DataFrame:
    """``share`` of the group total and ``deviation`` from the group mean."""
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(num(column)).alias("_sum"), F.avg(num(column)).alias("_mean")
    )
    joined = join_back(df, stats, by, "_n")
    return joined.select(
        *df.columns,
        ratio(num(column), F.col("_sum")).alias("share"),
        (num(column) - F.col("_mean")).alias("deviation"),
    )


def add_window(df: DataFrame, by, order, spec: dict, block_rows: int = 100_000) -> DataFrame:
    """Lag, moving mean and running total along ``order`` within ``by``.

    ``spec`` maps a name to ``("lag", column, k)``, ``("moving_mean", column, k)``
    (the current and k-1 earlier rows) or ``("running", column)``. ``order`` must
    end with a tie-breaker. Groups are cut into blocks of ``block_rows`` consecutive
    rows, each with copies of the rows its windows look back on, so that a group may be of any size.
    """
    by, order = list(by), list(order)
    reach = {n: s for n, s in spec.items() if s[0] != "running"}
    back = max([s[2] for s in reach.values()], default=0)

    def build(s):
        if s[0] == "lag":
            return lambda w: F.lag(s[1], s[2]).over(w)
        return lambda w: F.avg(num(s[1])).over(w.rowsBetween(1 - s[2], 0))

    aggs = {n: ("sum", num(s[1])) for n, s in spec.items() if s[0] == "running"}
    out = O.running(df, by, order, {**aggs, "pos": ("sum", F.lit(1).cast("bigint"))})
    if reach:
        out = O.with_halo(out, by, back, 0, max(block_rows, back + 1), {n: build(s) for n, s in reach.items()})
    return out.select(*df.columns, *spec)


def resample(df: DataFrame, ts: str, unit: str, metrics: dict, by=()) -> DataFrame:
    """Calendar periods (``hour``, ``day``, ``week``, ``month``...)."""
    return df.groupBy(*by, F.date_trunc(unit, F.col(ts)).alias("period")).agg(*_metrics(metrics))


def lump_rare(df: DataFrame, column: str, min_share: float, other: str = "other") -> DataFrame:
    """Levels below ``min_share`` of the rows become ``other``.

    There are at most ``1 / min_share`` frequent levels, so the kept list is small.
    """
    counts = value_counts(df, column).where(F.col("share") >= F.lit(min_share))
    kept = [r[0] for r in counts.where(F.col(column).isNotNull()).collect()]
    value = F.col(column)
    lumped = F.when(value.isNull(), value).when(value.isin(kept), value).otherwise(F.lit(other))
    return df.withColumn(column, lumped)
