"""A/B experiments: assignment, unit metrics, reports, resampling, planning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.functions.dist import norm_quantile, p_norm
from sparkmetrica.functions.scalars import hash_uniform, num, ratio
from sparkmetrica.operators import order as O
from sparkmetrica.operators.hypothesis import ARMS, chi2_gof, sq, two_arms, welch
from sparkmetrica.session import settle


def arm_of(unit, salt, weights=(0.5, 0.5)) -> Column:
    """Arm number of a unit: salted hash against cumulative weights."""
    u = unit if isinstance(unit, Column) else hash_uniform(unit, salt)
    total, upto = float(sum(weights)), 0.0
    arm = F.lit(len(weights) - 1)
    cuts = []
    for i, w in enumerate(weights[:-1]):
        upto += w / total
        cuts.append((i, upto))
    for i, cut in reversed(cuts):
        arm = F.when(u < F.lit(cut), F.lit(i)).otherwise(arm)
    return arm


def assign(df: DataFrame, unit: str, salt: str, weights=(0.5, 0.5), name: str = "arm") -> DataFrame:
    return df.withColumn(name, arm_of(unit, salt, weights))


def srm(df: DataFrame, arm: str, weights=(0.5, 0.5)) -> DataFrame:
    """Sample-ratio mismatch: chi-square of the arm counts against the weights; any other arm fails it."""
    return chi2_gof(df, arm, dict(enumerate(weights)))


def unit_metrics(events: DataFrame, unit: str, metrics: dict, units: DataFrame | None = None, window: Column | None = None) -> DataFrame:
    """Events to one row per unit. ``metrics`` maps names to aggregate columns.

    ``units`` (one row per assigned unit) keeps silent units with metric 0.
    """
    rows = events if window is None else events.where(window)
    per_unit = rows.groupBy(unit).agg(*[c.alias(n) for n, c in metrics.items()])
    if units is None:
        return per_unit
    kept = units.join(per_unit, unit, "left")
    return kept.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in metrics})


def _long_reps(units: DataFrame, B: int) -> DataFrame:
    return units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(B))))


def poisson_weight(u: Column, upto: int = 12) -> Column:
    """A Poisson(1) count from a uniform number, by inverting its distribution."""
    cuts, mass, total = [], math.exp(-1.0), 0.0
    for k in range(upto):
        total += mass
        cuts.append(total)
        mass /= k + 1
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(u >= F.lit(cut), 1).otherwise(0)
    return out.cast("bigint")


def weighed_reps(rows: DataFrame, B: int, seed: str) -> DataFrame:
    """Rows times replicates with the weight ``w`` of each unit in each."""
    reps = _long_reps(rows, B).withColumn("_u", hash_uniform(["rep", "unit"], seed))
    return reps.withColumn("w", poisson_weight(F.col("_u")))  # not filtered: that would hash twice


BRACKETS = 64


def bracket_cuts(rows: DataFrame) -> dict:
    """Values around the median of each arm, so close that every replicate's median should lie among them.

    The rank of a Poisson bootstrap's median varies by 0.7 over the square root of the units; the cuts reach six times as far
    on both sides. They only decide how much is left to order, not the answer.
    """
    out = {}
    for arm, n in rows.groupBy("arm").agg(F.count("y")).collect():  # one row an arm
        reach = min(0.5, 4.3 / math.sqrt(n))
        shares = [0.5 + reach * (2 * i / (BRACKETS - 2) - 1) for i in range(BRACKETS - 1)]
        accuracy = int(min(1_000_000, max(10_000, 40 * BRACKETS / reach)))
        found = rows.where(F.col("arm") == arm).agg(F.percentile_approx("y", shares, accuracy)).first()[0]
        out[arm] = sorted(set(found))
    return out


def bootstrap_medians(rows: DataFrame, B: int, seed: str) -> DataFrame:
    """``(rep, arm, median)`` of ``rows(unit, arm, y)``: exact, without ordering units times replicates.

    Weights are summed by bracket of the values where the rows are; these sums tell which bracket holds the middle of each replicate.
    Only values of that bracket are ordered, in that replicate. A replicate without weight in an arm has no median there.
    """
    rows = settle(rows)
    cuts = bracket_cuts(rows)
    place = F.lit(None).cast("int")
    for arm, values in cuts.items():
        edges = F.array(*[F.lit(float(v)) for v in values])
        place = F.when(F.col("arm") == arm, F.size(F.filter(edges, lambda c: c < F.col("y")))).otherwise(place)
    reps = weighed_reps(rows.withColumn("bracket", place), B, seed)
    sums = reps.groupBy("rep", "arm", "bracket").agg(F.sum("w").alias("w"))  # at most B times brackets rows from a task
    whole = Window.partitionBy("rep", "arm")
    upto = whole.orderBy("bracket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("w").over(upto), F.lit(0)), "total": F.sum("w").over(whole)})
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("w"))
    needed = sums.where((F.col("total") > 0) & (holds(low) | holds(high))).select("rep", "arm", "bracket", "before", low.alias("low"), high.alias("high"))
    # at most two brackets for each replicate and arm
    inside = reps.where("w > 0").join(F.broadcast(needed), ["rep", "arm", "bracket"])
    values = inside.groupBy("rep", "arm", "bracket", "before", "low", "high", "y").agg(F.sum("w").alias("w"))
    along = Window.partitionBy("rep", "arm", "bracket").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("w").over(along), F.lit(0))
    values = values.withColumn("first", first)
    at = lambda p: F.max(F.when((F.col("first") <= F.col(p)) & (F.col(p) < F.col("first") + F.col("w")), F.col("y")))
    return values.groupBy("rep", "arm").agg(at("low").alias("_low"), at("high").alias("_high")).select(
        "rep", "arm", (F.col("_low") + F.lit(0.5) * (F.col("_high") - F.col("_low"))).alias("median")
    )


def bootstrap_reps(df: DataFrame, unit: str, arm: str, y: str, B: int, seed: str, stat: str = "mean",
                   den: str | None = None, arms=ARMS) -> DataFrame:
    """Poisson bootstrap: the statistic of both arms and their difference per replicate.

    ``df`` is one row per unit. Weights are hashes of (replicate, unit), so every
    partition resamples its own rows and sends one partial sum per replicate. A
    replicate whose denominator is zero in an arm has no difference: NULL there.
    """
    columns = [F.col(unit).alias("unit"), F.col(arm).alias("arm"), num(y).alias("y")]
    columns += [num(den).alias("den")] if den else []
    rows = df.select(*columns).where(F.col("arm").isin(list(arms)) & F.col("y").isNotNull())
    if stat == "median":
        per_arm = bootstrap_medians(rows, B, seed)
        value = lambda a: F.max(F.when(F.col("arm") == a, F.col("median")))
    else:
        reps = weighed_reps(rows, B, seed)
        below = F.col("den") if stat == "ratio" else F.lit(1.0)
        per_arm = reps.groupBy("rep", "arm").agg(
            F.sum(F.col("w") * F.col("y")).alias("_y"), F.sum(F.col("w") * below).alias("_d")
        )
        value = lambda a: F.max(F.when(F.col("arm") == a, ratio("_y", "_d")))
    out = per_arm.groupBy("rep").agg(value(arms[0]).alias("stat0"), value(arms[1]).alias("stat1"))
    return out.withColumn("diff", F.col("stat1") - F.col("stat0"))


def bootstrap(df: DataFrame, unit: str, arm: str, y: str, B: int = 200, seed: str = "boot", stat: str = "mean",
              den: str | None = None, level: float = 0.95, arms=ARMS) -> DataFrame:
    """Bootstrap standard error and percentile interval of the difference between arms."""
    reps = bootstrap_reps(df, unit, arm, y, B, seed, stat, den, arms)
    lo, hi = (1 - level) / 2, (1 + level) / 2
    # one value per replicate: bounded by B
    return reps.agg(
        F.count("diff").alias("reps"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("se"),
        F.percentile("diff", F.lit(lo)).alias("ci_lo"),
        F.percentile("diff", F.lit(hi)).alias("ci_hi"),
    )


def permutation_test(df: DataFrame, unit: str, arm: str, y: str, B: int = 200, seed: str = "perm", arms=ARMS) -> DataFrame:
    """Permutation test of the difference in means, arm sizes held fixed.

    In each replicate the units are ordered by a salted hash and the first n1 are
    called treated. Sums by range of the hash find the range that holds unit n1; only the
    units of that range are put in order. So neither a shuffle nor a sort of units times B rows takes place.
    """
    rows = df.select(F.col(unit).alias("unit"), F.col(arm).alias("arm"), num(y).alias("y"))
    # one row per unit: computed once, since the replicates are counted, sampled and sorted
    rows = settle(rows.where(F.col("arm").isin(list(arms)) & F.col("y").isNotNull()))
    facts = rows.agg(
        F.count_if(F.col("arm") == arms[1]).alias("n1"),
        F.count_if(F.col("arm") == arms[0]).alias("n0"),
        F.avg(F.when(F.col("arm") == arms[1], F.col("y"))).alias("m1"),
        F.avg(F.when(F.col("arm") == arms[0], F.col("y"))).alias("m0"),
    ).first()
    n1, n0 = facts["n1"], facts["n0"]
    if not n1 or not n0:
        raise ValueError("both arms need units")
    observed = facts["m1"] - facts["m0"]
    reps = _long_reps(rows, B).withColumn("u", hash_uniform(["rep", "unit"], seed))
    ranges = max(64, min(1 << 16, (n1 + n0) // 256))
    reps = reps.withColumn("range", F.floor(F.col("u") * ranges).cast("int"))
    sums = reps.groupBy("rep", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum"))
    upto = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "sum_before": F.coalesce(F.sum("sum").over(upto), F.lit(0.0))})
    # one row per replicate
    edges = sums.where((F.col("before") < n1) & (F.col("before") + F.col("n") >= n1)).select("rep", "range", (F.lit(n1) - F.col("before")).alias("need"), "sum_before")
    inside = reps.join(F.broadcast(edges), ["rep", "range"])
    place = F.row_number().over(Window.partitionBy("rep").orderBy("u", "unit"))
    taken = inside.withColumn("place", place).where("place <= need").groupBy("rep").agg((F.first("sum_before") + F.sum("y")).alias("treated"))
    whole = facts["m1"] * n1 + facts["m0"] * n0
    diffs = taken.select("rep", (F.col("treated") / n1 - (F.lit(whole) - F.col("treated")) / n0).alias("diff"))
    # equal to the observed difference up to rounding counts as extreme
    edge = abs(observed) * (1 - 1e-12)
    out = diffs.agg(F.count("rep").alias("reps"), F.count_if(F.abs("diff") >= F.lit(edge)).alias("extreme"))
    return out.select(
        F.lit(observed).alias("diff"), "reps", "extreme",
        ((F.col("extreme") + 1) / (F.col("reps") + 1)).alias("p"),
    )


def cuped(df: DataFrame, arm: str, y: str, x: str, arms=ARMS, level: float = 0.95) -> DataFrame:
    """Welch test on ``y - theta (x - mean x)``, theta from all units of both arms.

    One scan: means, variances and covariances of the arms give the adjusted
    moments, so the adjusted metric is never materialised.
    """
    rows = df.select(F.col(arm).alias("arm"), num(y).alias("y"), num(x).alias("x"))
    rows = rows.where(F.col("arm").isin(list(arms))).dropna()
    aggs = [ratio(F.covar_samp("y", "x"), F.var_samp("x")).alias("theta"), F.avg("x").alias("_gx")]
    for i, a in enumerate(arms):
        yy, xx = F.when(F.col("arm") == a, F.col("y")), F.when(F.col("arm") == a, F.col("x"))
        aggs += [
            F.count(yy).alias(f"n{i}"), F.avg(yy).alias(f"_y{i}"), F.avg(xx).alias(f"_x{i}"),
            F.var_samp(yy).alias(f"_vy{i}"), F.var_samp(xx).alias(f"_vx{i}"), F.covar_samp(yy, xx).alias(f"_c{i}"),
        ]
    got = rows.agg(*aggs)
    th = F.col("theta")
    columns = {}
    for i in (0, 1):
        columns[f"mean{i}"] = F.col(f"_y{i}") - th * (F.col(f"_x{i}") - F.col("_gx"))
        columns[f"var{i}"] = F.col(f"_vy{i}") + sq(th) * F.col(f"_vx{i}") - 2 * th * F.col(f"_c{i}")
    raw_se = F.sqrt(ratio("_vy0", "n0") + ratio("_vy1", "n1"))
    stats = got.withColumns(columns).withColumn("raw_se", raw_se)
    return welch(stats.select("theta", "n0", "n1", "mean0", "mean1", "var0", "var1", "raw_se"), level)


def ratio_test(df: DataFrame, arm: str, num_col: str, den_col: str, arms=ARMS, level: float = 0.95) -> DataFrame:
    """Difference of ratios of totals (clicks per view) with delta-method variance."""
    rows = df.select(F.col(arm).alias("arm"), num(num_col).alias("a"), num(den_col).alias("b")).dropna()
    aggs = []
    for i, v in enumerate(arms):
        a, b = F.when(F.col("arm") == v, F.col("a")), F.when(F.col("arm") == v, F.col("b"))
        aggs += [
            F.count(a).alias(f"n{i}"), F.avg(a).alias(f"_a{i}"), F.avg(b).alias(f"_b{i}"),
            F.var_samp(a).alias(f"_va{i}"), F.var_samp(b).alias(f"_vb{i}"), F.covar_samp(a, b).alias(f"_c{i}"),
        ]
    got = rows.agg(*aggs)
    got = got.withColumns({f"ratio{i}": ratio(f"_a{i}", f"_b{i}") for i in (0, 1)})
    variances = [
        ratio(
            F.col(f"_va{i}") - 2 * F.col(f"ratio{i}") * F.col(f"_c{i}") + sq(F.col(f"ratio{i}")) * F.col(f"_vb{i}"),
            F.col(f"n{i}") * sq(F.col(f"_b{i}")),
        )
        for i in (0, 1)
    ]
    out = got.select("n0", "n1", "ratio0", "ratio1", F.sqrt(variances[0] + variances[1]).alias("se"))
    return _finish_z(out.withColumn("diff", F.col("ratio1") - F.col("ratio0")), level)


def _finish_z(df: DataFrame, level: float) -> DataFrame:
    half = F.lit(norm_quantile(0.5 + level / 2)) * F.col("se")
    return (
        df.withColumn("z", ratio("diff", "se"))
        .withColumn("p", p_norm(F.col("z")))
        .withColumns({"ci_lo": F.col("diff") - half, "ci_hi": F.col("diff") + half})
    )


def stratified_test(df: DataFrame, arm: str, y: str, stratum: str, arms=ARMS, level: float = 0.95) -> DataFrame:
    """Post-stratified difference: strata weighted by their share of the units.

    Strata where an arm has fewer than two units carry no estimate; they are left
    out of the weights and their units are counted in ``n_unused``.
    """
    stats = two_arms(df.where(F.col(arm).isin(list(arms))), arm, y, arms, [stratum])
    usable = (F.col("n0") >= 2) & (F.col("n1") >= 2)
    n = (F.col("n0") + F.col("n1")).cast("double")
    diff = F.col("mean1") - F.col("mean0")
    var = ratio("var1", "n1") + ratio("var0", "n0")
    out = stats.agg(
        F.count_if(usable).alias("strata"),
        F.sum(F.when(usable, n)).alias("_n"),
        F.coalesce(F.sum(F.when(~usable, n)), F.lit(0.0)).cast("bigint").alias("n_unused"),
        F.sum(F.when(usable, n * diff)).alias("_d"),
        F.sum(F.when(usable, n * n * var)).alias("_v"),
    )
    out = out.select("strata", "n_unused", ratio("_d", "_n").alias("diff"), F.sqrt(ratio("_v", F.col("_n") * F.col("_n"))).alias("se"))
    return _finish_z(out, level)


def ab_report(df: DataFrame, arm: str, metrics, segments=(), control=0, level: float = 0.95) -> DataFrame:
    """Every metric, in total and by each segment column, every arm against control.

    One pass over the unit rows: grouping sets give all segmentations at once and
    all metrics are aggregates of the same group; rows are unpivoted afterwards. A level
    without control rows, or without any other arm (``arm`` is NULL then), keeps its
    row, with NULL for what can't be compared.
    """
    metrics, segments = list(metrics), list(segments)
    keys = [F.col(arm)] + [F.col(s) for s in segments]
    sets = [[F.col(arm)]] + [[F.col(arm), F.col(s)] for s in segments]
    aggs = [F.grouping_id().alias("_level")]
    for i, m in enumerate(metrics):
        aggs += [F.count(num(m)).alias(f"_n{i}"), F.avg(num(m)).alias(f"_m{i}"), F.var_samp(num(m)).alias(f"_v{i}")]
    grouped = df.groupingSets(sets, *keys).agg(*aggs)
    # grouping_id has one bit per key, first key highest, set where the key is rolled up
    name, value, k = F.lit("all"), F.lit(None).cast("string"), len(segments)
    for i, s in enumerate(segments):
        here = F.col("_level") == F.lit(sum(1 << (k - 1 - j) for j in range(k) if j != i))
        name = F.when(here, F.lit(s)).otherwise(name)
        value = F.when(here, F.col(s).cast("string")).otherwise(value)
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"), F.col(f"_v{i}").alias("var"))
        for i, m in enumerate(metrics)
    ])
    long = settle(grouped.select(F.col(arm).alias("arm"), name.alias("segment"), value.alias("level"), F.inline(entries)))
    sides = {
        i: long.where(cond).withColumnsRenamed({"n": f"n{i}", "mean": f"mean{i}", "var": f"var{i}"})
        for i, cond in ((0, F.col("arm") == F.lit(control)), (1, F.col("arm") != F.lit(control)))
    }
    base = sides[0].drop("arm").withColumnsRenamed({"segment": "_s", "level": "_l", "metric": "_m"})
    same = (F.col("segment") == F.col("_s")) & F.col("level").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m"))
    both = sides[1].join(base, same, "full_outer")
    both = both.withColumns({"segment": F.coalesce("segment", "_s"), "metric": F.coalesce("metric", "_m"), "level": F.coalesce("level", "_l")}).drop("_s", "_l", "_m")
    out = welch(both, level)
    return out.withColumn("lift", ratio("diff", "mean0")).drop("var0", "var1")


def adjust_p(df: DataFrame, p: str, method: str = "bh", key: str | None = None, name: str = "p_adj") -> DataFrame:
    """Adjusted p-values: ``bonferroni``, ``holm`` or ``bh``; NULL p stays out.

    ``key`` is a unique tie-breaker; adjusted values do not depend on it.
    """
    rows = df.where(F.col(p).isNotNull())
    if method == "bonferroni":
        m = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
        return rows.withColumn(name, F.least(F.lit(1.0), F.col(p) * m))
    tie = [F.col(key)] if key else []
    placed = O.positions(rows, [F.col(p), *tie])
    if method == "holm":
        scaled = F.col(p) * (F.col("pos_total") - F.col("pos") + 1)
        out = O.running(placed, [], [F.col("pos")], {name: ("max", scaled)})
    else:
        scaled = F.col(p) * F.col("pos_total") / F.col("pos")
        out = O.running(placed, [], [F.col("pos").desc()], {name: ("min", scaled)})
    return out.withColumn(name, F.least(F.lit(1.0), F.col(name))).drop("pos", "pos_total")


def power_table(df: DataFrame, metric: str, effects=(0.01, 0.02, 0.05), alphas=(0.05,), powers=(0.8,)) -> DataFrame:
    """Units per arm to detect a relative effect, for a grid of levels and powers."""
    base = df.agg(F.count(num(metric)).alias("n"), F.avg(num(metric)).alias("mean"), F.var_samp(num(metric)).alias("var"))
    grid = [
        F.struct(
            F.lit(float(e)).alias("effect"), F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("power"),
            F.lit(norm_quantile(1 - a / 2) + norm_quantile(b)).alias("_z"),
        )
        for e in effects for a in alphas for b in powers
    ]
    rows = base.select("n", "mean", "var", F.inline(F.array(*grid)))
    delta = F.col("effect") * F.col("mean")
    need = F.ceil(ratio(2 * sq(F.col("_z")) * F.col("var"), sq(delta)))
    now = F.col("_z") * F.sqrt(ratio(4 * F.col("var"), "n"))
    return rows.select(
        "effect", "alpha", "power", "mean", F.sqrt("var").alias("sd"),
        need.alias("n_per_arm"), now.alias("mde"), ratio(now, "mean").alias("mde_relative"),
    )


def achieved_power(df: DataFrame, metric: str, effect: float, n_per_arm: int, alpha: float = 0.05) -> float:
    """Power to see a relative ``effect`` with ``n_per_arm`` units (normal approximation)."""
    mean, var = df.agg(F.avg(num(metric)), F.var_samp(num(metric))).first()
    shift = abs(effect * mean) / math.sqrt(2 * var / n_per_arm)
    upper = shift - norm_quantile(1 - alpha / 2)
    return 0.5 * math.erfc(-upper / math.sqrt(2))


def aa_tests(df: DataFrame, unit: str, y: str, salts: int = 100, seed: str = "aa", weights=(0.5, 0.5)) -> DataFrame:
    """One Welch test per salt on units that were all treated alike."""
    rows = df.select(F.col(unit).alias("unit"), num(y).alias("y")).dropna()
    long = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    long = long.withColumn("arm", arm_of(hash_uniform(["salt", "unit"], seed), None, weights))
    return welch(two_arms(long, "arm", "y", by=["salt"]))


def aa_check(df: DataFrame, unit: str, y: str, salts: int = 100, seed: str = "aa", alpha: float = 0.05) -> DataFrame:
    """Share of A/A tests that reject, and the binomial band it should lie in."""
    tests = aa_tests(df, unit, y, salts, seed)
    half = norm_quantile(0.995) * math.sqrt(alpha * (1 - alpha) / salts)
    return tests.agg(
        F.count("p").alias("tests"),
        F.count_if(F.col("p") < alpha).alias("rejected"),
        F.avg((F.col("p") < alpha).cast("double")).alias("rate"),
    ).withColumns({"band_lo": F.lit(max(0.0, alpha - half)), "band_hi": F.lit(alpha + half)})
