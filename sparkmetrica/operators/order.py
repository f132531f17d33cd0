"""Order statistics without an unpartitioned window.

Ordering a whole table, or one group that holds a third of it, in a single
window would send all of it to one task. Here the rows are range-partitioned on
``(by, order)`` instead, the partition number is kept as a block number, windows
run inside ``(by, block)``, and a small table with one row per group and block
carries the totals of the earlier blocks forward. Rank, cumulative count,
quantile, ROC and running-total operators are all built on :func:`running`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import col, num
from sparkmetrica.session import settle

_COMBINE = {
    "sum": (F.sum, lambda mine, before: mine + F.coalesce(before, F.lit(0))),
    "max": (F.max, lambda mine, before: F.greatest(mine, before)),
    "min": (F.min, lambda mine, before: F.least(mine, before)),
}


def _key(names) -> Column:
    """Several key columns as one value, so that NULL keys match each other."""
    return F.struct(*[F.col(n) for n in names])


def running(df: DataFrame, by, order, aggs: dict, totals: bool = False) -> DataFrame:
    """Running aggregates from the first row of each group to the current one.

    ``order`` is a list of columns (``F.desc`` allowed) that must order each
    group without ties; ``aggs`` maps an output name to ``(kind, column)`` with
    kind ``sum``, ``max`` or ``min``. With ``totals`` the whole-group value is
    added as ``<name>_total``.
    """
    by = list(by)
    group = [F.col(b) for b in by] or [F.lit(0)]
    whole = Window.partitionBy(*group)
    inputs = {f"_in_{n}": c for n, (_, c) in aggs.items()}
    blocks = df.withColumns(inputs).repartitionByRange(*[F.col(b) for b in by], *order)
    # The join key is made before the window, so that the join finds its rows partitioned.
    at = F.struct(*[F.col(b) for b in by], F.col("_block"))
    blocks = settle(blocks.withColumn("_block", F.spark_partition_id()).withColumn("_at", at))

    sums = blocks.groupBy("_at").agg(*[_COMBINE[kind][0](f"_in_{n}").alias(f"_sum_{n}") for n, (kind, _) in aggs.items()])
    sums = sums.select("_at", "_at.*", *[f"_sum_{n}" for n in aggs])
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col("_at")]
    for n, (kind, _) in aggs.items():
        carry.append(_COMBINE[kind][0](f"_sum_{n}").over(earlier).alias(f"_before_{n}"))
        if totals:
            carry.append(_COMBINE[kind][0](f"_sum_{n}").over(whole).alias(f"{n}_total"))
    carry = sums.select(*carry)

    upto = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumns({n: _COMBINE[kind][0](f"_in_{n}").over(upto) for n, (kind, _) in aggs.items()})
    joined = local.join(carry, "_at", "left")
    out = joined.withColumns(
        {n: _COMBINE[kind][1](F.col(n), F.col(f"_before_{n}")) for n, (kind, _) in aggs.items()}
    )
    return out.drop("_at", "_block", *inputs, *[f"_before_{n}" for n in aggs])


def positions(df: DataFrame, order, by=()) -> DataFrame:
    """Adds ``pos`` (1-based place of the row in its group) and ``pos_total``."""
    return running(df, by, order, {"pos": ("sum", F.lit(1).cast("bigint"))}, totals=True)


def ordered_counts(
    df: DataFrame, value: str | Column, by=(), sums: dict | None = None, descending: bool = False
) -> DataFrame:
    """One row per distinct value: ``n``, ``n_before`` and ``n_total``.

    ``sums`` adds further summed columns with the same three forms, for example
    the number of positive labels at each score. Equal values are counted before
    anything is ordered, so one value may hold any share of the rows.
    """
    aggs = {"n": F.lit(1).cast("bigint"), **(sums or {})}
    by = list(by)
    rows = df.select(*[F.col(b) for b in by], num(value).alias("value"), *[c.alias(f"_w_{n}") for n, c in aggs.items()])
    counts = settle(rows.groupBy(*by, "value").agg(*[F.sum(f"_w_{n}").alias(f"_c_{n}") for n in aggs]))
    counts = counts.where(F.col("value").isNotNull())
    order = F.col("value").desc() if descending else F.col("value").asc()
    out = running(counts, by, [order], {n: ("sum", F.col(f"_c_{n}")) for n in aggs}, totals=True)
    shaped = []
    for n in aggs:
        shaped += [
            F.col(f"_c_{n}").alias(n),
            (F.col(n) - F.col(f"_c_{n}")).alias(f"{n}_before"),
            F.col(f"{n}_total"),
        ]
    return out.select(*by, "value", *shaped)


def join_back(rows: DataFrame, stats: DataFrame, keys, size: str, total: int | None = None) -> DataFrame:
    """Adds the columns of ``stats`` (one row per key, NULL keys included) to ``rows``.

    With ``total``, the sum of ``size``, ``stats`` is taken as written already. ``size`` is the column of ``stats`` with the number of rows behind a key. A key is
    hot if it has more rows than an average task of the join would get, so there are
    fewer hot keys than shuffle partitions. Their rows stay where they are and
    meet a broadcast of these keys; all others are joined by key, broadcast or
    shuffled as Spark finds it fit. Equal rows need no spreading that way.
    """
    keys = list(keys)
    if total is None:
        stats = settle(stats)
        total = stats.agg(F.sum(size)).first()[0] or 0
    extra = [c for c in stats.columns if c not in keys]
    packed = stats.select(_key(keys).alias("_k"), F.struct(*extra).alias("_s"))
    keyed = rows.withColumn("_k", _key(keys))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.coalesce(F.col(f"_s.{size}") * tasks > F.lit(total), F.lit(False))
    hot = F.broadcast(packed.where(is_hot))
    cold = packed.where(~is_hot)
    spread = keyed.join(hot, "_k")
    rest = keyed.join(hot.select("_k"), "_k", "left_anti").join(cold, "_k", "left")
    shape = [*[F.col(c) for c in rows.columns], *[F.col(f"_s.{c}").alias(c) for c in extra]]
    return spread.select(*shape).unionByName(rest.select(*shape))


def rank_table(df: DataFrame, column: str, by=(), name: str = "rank") -> DataFrame:
    """Mid-rank (ties share the average) of each distinct value, for :func:`add_rank`."""
    return ordered_counts(df, column, by).select(
        *by,
        F.col("value").alias("_value"),
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name),
        F.col("n").alias("_n"),
    )


def add_rank(df: DataFrame, ranks: DataFrame, column: str, by=()) -> DataFrame:
    rows = df.withColumn("_value", num(column))
    return join_back(rows, ranks, [*by, "_value"], "_n").drop("_value", "_n")


def avg_rank(df: DataFrame, column: str, by=(), name: str = "rank") -> DataFrame:
    """Adds the mid-rank of ``column`` within ``by``."""
    return add_rank(df, rank_table(df, column, by, name), column, by)


def all_ranks(df: DataFrame, columns) -> DataFrame:
    """Every column replaced by its mid-ranks.

    Values of all columns are counted and ordered together, as (column, value) pairs: one range exchange and one table of ranks,
    whatever the number of columns. Each column then meets its part of that table.
    """
    columns = list(columns)
    entries = [F.struct(F.lit(i).alias("_i"), num(c).alias("_value")) for i, c in enumerate(columns)]
    ranks = settle(rank_table(df.select(F.inline(F.array(*entries))), "_value", ["_i"]))
    totals = {r[0]: r[1] for r in ranks.groupBy("_i").agg(F.sum("_n")).collect()}  # one row a column
    out = df.select(*[num(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        own = ranks.where(F.col("_i") == i).select(F.col("_value").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"), F.col("_n").alias(f"_n{i}"))
        out = join_back(out, own, [f"_v{i}"], f"_n{i}", totals.get(i, 0)).drop(f"_n{i}")
    return out.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)])


def quantile_name(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


def exact_quantiles(df: DataFrame, column: str | Column, probs, by=(), weight: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group (``q25``, ``q50``...).

    Order statistics come from cumulative counts over distinct values, so no
    group has to fit in one task. ``weight`` is an integer number of copies.
    """
    if weight is None:
        return quantiles_of(ordered_counts(df, column, by), probs, by)
    return quantiles_of(ordered_counts(df, column, by, {"w": weight}).where("w > 0"), probs, by, "w")


def quantiles_of(counts: DataFrame, probs, by=(), n: str = "n") -> DataFrame:
    """Exact quantiles read off a table made by :func:`ordered_counts`."""
    by = list(by)
    first, last = F.col(f"{n}_before"), F.col(f"{n}_before") + F.col(n) - 1
    aggs = [F.max(f"{n}_total").alias("n")]
    for i, p in enumerate(probs):
        at = (F.col(f"{n}_total") - 1) * F.lit(float(p))
        for edge, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (first <= place) & (place <= last)
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"_{edge}{i}"))
    picked = counts.groupBy(*by).agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        share = at - F.floor(at)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + share * (high - low)).alias(quantile_name(p)))
    return picked.select(*by, F.col("n"), *out)


def with_halo(placed: DataFrame, by, back: int, ahead: int, block_rows: int, specs: dict) -> DataFrame:
    """Window columns that look at most ``back`` rows back and ``ahead`` rows on.

    ``placed`` has the place ``pos`` of each row in its group. Rows are cut into
    blocks of ``block_rows`` consecutive places, and each block gets copies of the
    neighbours its windows can see; copies are dropped afterwards. ``specs`` maps
    a name to ``f(window) -> Column``.
    """
    if block_rows <= max(back, ahead):
        raise ValueError("block_rows must exceed the reach of the window")
    at = F.col("pos") - 1
    home = F.floor(at / F.lit(block_rows))
    inside = F.pmod(at, F.lit(block_rows))
    homes = F.array(
        home,
        F.when(inside >= block_rows - back, home + 1),
        F.when(inside < ahead, home - 1),
    )
    copies = placed.withColumn("_home", home).withColumn("_cut", F.explode(F.array_compact(homes)))
    window = Window.partitionBy(*by, "_cut").orderBy("pos")
    out = copies.withColumns({name: build(window) for name, build in specs.items()})
    return out.where("_cut = _home").drop("_cut", "_home")


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
