"""Hypothesis tests. Each takes rows and returns a one-row DataFrame.

The data is touched by one aggregation (or by cumulative counts over distinct
values for the rank tests); the test statistic is column arithmetic on its result.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest, KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.functions.dist import norm_quantile, p_chi2, p_f, p_kolmogorov, p_norm, p_t, t_crit
from sparkmetrica.functions.scalars import col, num, ratio
from sparkmetrica.operators.order import all_ranks, exact_quantiles, join_back, ordered_counts
from sparkmetrica.session import settle

ARMS = (0, 1)  # control, treatment


def sq(c: Column) -> Column:
    return c * c


def two_arms(df: DataFrame, arm: str, y: str | Column, arms=ARMS, by=()) -> DataFrame:
    """Count, mean and sample variance of ``y`` in both arms, side by side."""
    aggs = []
    for side, value in enumerate(arms):
        picked = F.when(F.col(arm) == value, num(y))
        aggs += [
            F.count(picked).alias(f"n{side}"),
            F.avg(picked).alias(f"mean{side}"),
            F.var_samp(picked).alias(f"var{side}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def welch(stats: DataFrame, level: float = 0.95) -> DataFrame:
    """Welch statistics from ``n, mean, var`` of two arms; keeps other columns."""
    a0, a1 = ratio("var0", "n0"), ratio("var1", "n1")
    df = ratio(sq(a0 + a1), ratio(sq(a0), F.col("n0") - 1) + ratio(sq(a1), F.col("n1") - 1))
    out = stats.withColumns({"diff": F.col("mean1") - F.col("mean0"), "se": F.sqrt(a0 + a1), "df": df})
    return _finish_t(out, level)


def _finish_t(df: DataFrame, level: float) -> DataFrame:
    half = t_crit(F.col("df"), level) * F.col("se")
    return (
        df.withColumn("t", ratio("diff", "se"))
        .withColumn("p", p_t(F.col("t"), F.col("df")))
        .withColumns({"ci_lo": F.col("diff") - half, "ci_hi": F.col("diff") + half})
    )


def ttest(df: DataFrame, y: str, arm: str | None = None, kind: str = "welch", other: str | None = None,
          mu: float = 0.0, arms=ARMS, level: float = 0.95) -> DataFrame:
    """Student tests: ``welch``, ``pooled``, ``one`` sample, ``paired`` with ``other``."""
    if kind in ("one", "paired"):
        value = num(y) - (num(other) if kind == "paired" else F.lit(float(mu)))
        one = df.agg(F.count(value).alias("n"), F.avg(value).alias("diff"), F.var_samp(value).alias("var"))
        one = one.withColumns({"se": F.sqrt(ratio("var", "n")), "df": (F.col("n") - 1).cast("double")})
        return _finish_t(one, level)
    stats = two_arms(df, arm, y, arms)
    if kind == "welch":
        return welch(stats, level)
    freedom = (F.col("n0") + F.col("n1") - 2).cast("double")
    pooled = ratio((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1"), freedom)
    se = F.sqrt(pooled * (ratio(F.lit(1), "n0") + ratio(F.lit(1), "n1")))
    return _finish_t(stats.withColumns({"diff": F.col("mean1") - F.col("mean0"), "se": se, "df": freedom}), level)


def prop_ztest(df: DataFrame, y: str, arm: str | None = None, p0: float = 0.5, arms=ARMS, level: float = 0.95) -> DataFrame:
    """z-test for one proportion against ``p0``, or for two arms (pooled z)."""
    zc = norm_quantile(0.5 + level / 2)
    if arm is None:
        out = df.agg(F.count(num(y)).alias("n"), F.avg(num(y)).alias("p1"))
        se0 = F.sqrt(ratio(F.lit(p0 * (1 - p0)), "n"))
        out = out.withColumns({"diff": F.col("p1") - F.lit(p0), "z": ratio(F.col("p1") - F.lit(p0), se0)})
        half = F.lit(zc) * F.sqrt(ratio(F.col("p1") * (1 - F.col("p1")), "n"))
    else:
        stats = two_arms(df, arm, y, arms).withColumnsRenamed({"mean0": "p0", "mean1": "p1"})
        pool = ratio(F.col("n0") * F.col("p0") + F.col("n1") * F.col("p1"), F.col("n0") + F.col("n1"))
        se0 = F.sqrt(pool * (1 - pool) * (ratio(F.lit(1), "n0") + ratio(F.lit(1), "n1")))
        out = stats.drop("var0", "var1").withColumn("diff", F.col("p1") - F.col("p0"))
        out = out.withColumn("z", ratio("diff", se0))
        own = [ratio(F.col(f"p{i}") * (1 - F.col(f"p{i}")), f"n{i}") for i in (0, 1)]
        half = F.lit(zc) * F.sqrt(own[0] + own[1])
    return out.withColumns(
        {"p": p_norm(F.col("z")), "ci_lo": F.col("diff") - half, "ci_hi": F.col("diff") + half}
    )


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories from their contingency table, with Cramer's V."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    margins = cells.withColumns(
        {"_ra": F.sum("n").over(Window.partitionBy(a)), "_rb": F.sum("n").over(Window.partitionBy(b))}
    )
    out = margins.agg(
        F.sum("n").alias("n"),
        F.sum(ratio(sq(F.col("n").cast("double")), F.col("_ra").cast("double") * F.col("_rb"))).alias("_s"),
        F.count_distinct(a).alias("_a"),
        F.count_distinct(b).alias("_b"),
    )
    out = out.select(
        "n",
        (F.col("n") * (F.col("_s") - 1)).alias("chi2"),
        ((F.col("_a") - 1) * (F.col("_b") - 1)).alias("df"),
        F.least(F.col("_a") - 1, F.col("_b") - 1).alias("_m"),
    )
    v = F.sqrt(ratio("chi2", F.col("n") * F.col("_m")))
    return out.withColumns({"cramers_v": v, "p": p_chi2(F.col("chi2"), F.col("df"))}).drop("_m")


def chi2_gof(df: DataFrame, a: str, expected: dict) -> DataFrame:
    """Goodness of fit of the levels of ``a`` to ``expected`` weights.

    Rows with a level that is not expected are counted in ``n_unexpected``; one such
    row refutes the weights, so ``p`` is 0 then. ``n`` and ``chi2`` are of the expected levels.
    """
    total = float(sum(expected.values()))
    counts = [F.count_if(F.col(a) == F.lit(v)).alias(f"_{i}") for i, v in enumerate(expected)]
    row = df.agg(*counts, F.count_if(~F.col(a).isin(list(expected))).alias("_other"))
    n = sum((F.col(f"_{i}") for i in range(1, len(expected))), F.col("_0"))
    parts = []
    for i, w in enumerate(expected.values()):
        e = n * F.lit(w / total)
        parts.append(ratio(sq(F.col(f"_{i}") - e), e))
    out = row.select(
        n.alias("n"), F.col("_other").alias("n_unexpected"), sum(parts[1:], parts[0]).alias("chi2"), F.lit(len(expected) - 1).alias("df")
    )
    return out.withColumn("p", F.when(F.col("n_unexpected") > 0, F.lit(0.0)).otherwise(p_chi2(F.col("chi2"), F.col("df"))))


def chi2_feature_test(df: DataFrame, features, label: str) -> DataFrame:
    """Spark ML's chi-square test of several categorical columns against a label.

    Rows with a missing feature or label are left out and counted in ``n_dropped``.
    """
    needed = [*features, label]
    complete = F.lit(True)
    for c in needed:
        complete = complete & num(c).isNotNull()
    n_dropped = df.agg(F.count_if(~complete)).first()[0]
    assembled = VectorAssembler(inputCols=list(features), outputCol="_f").transform(df.where(complete))
    return ChiSquareTest.test(assembled, "_f", label, flatten=True).withColumn("n_dropped", F.lit(n_dropped))


def anova(df: DataFrame, group: str, y: str | Column) -> DataFrame:
    """One-way analysis of variance: F, degrees of freedom, eta squared."""
    rows = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    stats = settle(
        rows.groupBy("g").agg(
            F.count("y").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("within")
        )
    )
    grand = stats.agg(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).first()[0]
    out = stats.agg(
        F.sum("n").alias("n"),
        F.count("g").alias("k"),
        F.sum(F.col("n") * sq(F.col("mean") - F.lit(grand).cast("double"))).alias("ss_between"),
        F.sum("within").alias("ss_within"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return out.withColumns({"df1": d1, "df2": d2}).select(
        "n", "k", "df1", "df2", "ss_between", "ss_within",
        ratio(ratio("ss_between", "df1"), ratio("ss_within", "df2")).alias("f"),
        ratio("ss_between", F.col("ss_between") + F.col("ss_within")).alias("eta2"),
    ).withColumn("p", p_f(F.col("f"), F.col("df1"), F.col("df2")))


def levene(df: DataFrame, group: str, y: str, center: str = "median") -> DataFrame:
    """Equal variances: Levene (``mean``) or Brown-Forsythe (exact ``median``)."""
    rows = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    if center == "mean":
        centers = rows.groupBy("g").agg(F.count("y").alias("n"), F.avg("y").alias("_c"))
    else:
        centers = exact_quantiles(rows, "y", (0.5,), ["g"]).withColumnRenamed("q50", "_c")
    joined = join_back(rows, centers, ["g"], "n")
    return anova(joined.select("g", F.abs(F.col("y") - F.col("_c")).alias("d")), "g", "d")


def mannwhitney(df: DataFrame, arm: str, y: str, arms=ARMS) -> DataFrame:
    """Mann-Whitney U of the treatment arm, tie-corrected normal approximation."""
    rows = df.where(F.col(arm).isin(list(arms)))
    treated = F.when(F.col(arm) == arms[1], 1).otherwise(0).cast("bigint")
    counts = ordered_counts(rows, y, sums={"t": treated})
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    n = F.col("n").cast("double")
    out = counts.agg(
        F.sum("t").alias("n1"),
        F.sum(F.col("n") - F.col("t")).alias("n0"),
        F.sum(rank * F.col("t")).alias("_r"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    u = F.col("_r") - n1 * (n1 + 1) / 2
    total = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (total + 1 - ratio("ties", total * (total - 1))))
    out = out.select("n1", "n0", u.alias("u"), "ties", sd.alias("sd"), ratio(u - n1 * n0 / 2, sd).alias("z"),
                     ratio(u, n1 * n0).alias("prob_superior"))
    return out.withColumn("p", p_norm(F.col("z")))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon signed rank of ``a - b``; zero differences are left out."""
    rows = df.select((num(a) - num(b)).alias("d")).where("d <> 0")
    counts = ordered_counts(
        rows.select(F.abs("d").alias("m"), "d"), "m", sums={"pos": F.when(F.col("d") > 0, 1).otherwise(0).cast("bigint")}
    )
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    c = F.col("n").cast("double")
    out = counts.agg(
        F.sum("n").alias("n"),
        F.sum(rank * F.col("pos")).alias("w_plus"),
        F.sum(rank * (F.col("n") - F.col("pos"))).alias("w_minus"),
        F.sum(c * c * c - c).alias("ties"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = out.withColumn("z", ratio(F.col("w_plus") - n * (n + 1) / 4, sd))
    return out.withColumn("p", p_norm(F.col("z")))


def ks_2samp(df: DataFrame, arm: str, y: str, arms=ARMS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: largest gap between the empirical distributions."""
    rows = df.where(F.col(arm).isin(list(arms)))
    treated = F.when(F.col(arm) == arms[1], 1).otherwise(0).cast("bigint")
    counts = ordered_counts(rows, y, sums={"t": treated, "c": 1 - treated})
    gap = F.abs(
        ratio(F.col("t_before") + F.col("t"), "t_total") - ratio(F.col("c_before") + F.col("c"), "c_total")
    )
    out = counts.agg(F.max("t_total").alias("n1"), F.max("c_total").alias("n0"), F.max(gap).alias("d"))
    scale = F.sqrt(ratio(F.col("n1").cast("double") * F.col("n0"), F.col("n1") + F.col("n0")))
    return out.withColumn("p", p_kolmogorov(F.col("d") * scale))


def ks_1samp(df: DataFrame, column: str, mean: float | None = None, sd: float | None = None) -> DataFrame:
    """One-sample test against a normal law (the sample's own moments by default).

    The p-value is that of a law known beforehand, so it is NULL where a moment is the sample's own.
    """
    known = mean is not None and sd is not None
    rows = df.select(num(column).alias("sample")).dropna()
    if mean is None or sd is None:
        own = rows.agg(F.avg("sample"), F.stddev_samp("sample")).first()
        mean, sd = own[0] if mean is None else mean, own[1] if sd is None else sd
    found = KolmogorovSmirnovTest.test(rows, "sample", "norm", float(mean), float(sd))
    return found if known else found.withColumn("pValue", F.lit(None).cast("double"))


def jarque_bera(df: DataFrame, column: str | Column) -> DataFrame:
    """Normality by skewness and kurtosis, chi-square with 2 degrees of freedom."""
    y = num(column)
    out = df.agg(F.count(y).alias("n"), F.skewness(y).alias("skewness"), F.kurtosis(y).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (sq(F.col("skewness")) + sq(F.col("kurtosis")) / 4.0)
    return out.withColumn("jb", jb).withColumn("p", p_chi2(F.col("jb"), F.lit(2.0)))


def corr_test(df: DataFrame, a: str, b: str, kind: str = "pearson") -> DataFrame:
    """Correlation and its t-test on complete pairs; ``spearman`` uses mid-ranks."""
    rows = df.select(num(a).alias("a"), num(b).alias("b")).dropna()
    if kind == "spearman":
        rows = all_ranks(rows, ["a", "b"])
    out = rows.agg(F.count("a").alias("n"), F.corr("a", "b").alias("r"))
    out = out.withColumn("df", F.col("n") - 2)
    out = out.withColumn("t", F.col("r") * F.sqrt(ratio("df", 1 - sq(F.col("r")))))
    return out.withColumn("p", p_t(F.col("t"), F.col("df")))
