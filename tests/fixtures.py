"""Data with a planted truth, from hashes of the row number: the same on every run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import hash_uniform


def uniform(name: str):
    return hash_uniform("id", name) - 0.5


def hidden_factor(spark, n=20_000, strength=(1.0, 0.5), invalid=0.0):
    """The slope of x is 2; ``strength`` weakens the instruments, ``invalid`` lets z2 into y."""
    df = spark.range(n).withColumns({c: uniform(c) for c in ("z1", "z2", "w", "u", "e1", "e2")})
    x = strength[0] * F.col("z1") + strength[1] * F.col("z2") + 0.8 * F.col("u") + F.col("e1")
    y = 1 + 2 * F.col("x") + 0.3 * F.col("w") + F.col("u") + F.col("e2") + invalid * F.col("z2")
    return df.withColumn("x", x).withColumn("y", y).withColumn("cluster", (F.col("id") % 50).cast("int"))


def listings(spark, n=6000):
    """ln(price) = 9 + 0.8 ln(area) - 0.05 distance + district; noise grows with area."""
    df = spark.range(n).withColumns(
        {"area": 60 + 80 * uniform("area"), "dist": 8 + 12 * uniform("dist"), "district": F.concat(F.lit("d"), (F.col("id") % 4).cast("string"))}
    )
    noise = 0.004 * F.col("area") * (uniform("a") + uniform("b") + uniform("c"))
    effect = 0.1 * (F.col("id") % 4)
    df = df.withColumn("ln_price", 9 + 0.8 * F.ln("area") - 0.05 * F.col("dist") + effect + noise)
    return df.withColumns({
        "price": F.exp("ln_price"), "ln_area": F.ln("area"), "one": F.lit(3.0),
        "twice": 2 * F.col("dist") - 1, "gap": F.when(F.col("id") % 10 != 3, F.col("dist")),
    })


def experiment(spark, n=8000, lift=0.2, share=0.5):
    """Outcome driven by a pre-period metric; treated units gain ``lift``."""
    df = spark.range(n).withColumns({c: uniform(c) for c in ("p", "q", "r", "s")})
    df = df.withColumn("arm", (F.col("s") + 0.5 < share).cast("int"))
    pre = 5 + 2 * F.col("p")
    return df.withColumns({
        "pre": pre, "y": pre + 0.5 * F.col("q") + lift * F.col("arm"), "noise": F.col("q"),
        "views": F.floor(10 + 10 * (F.col("r") + 0.5)), "clicks": F.floor(3 + 4 * (F.col("q") + 0.5)) + F.col("arm"),
        "converted": (F.col("q") + 0.5 < 0.3 + 0.1 * F.col("arm")).cast("int"),
        "segment": F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))),
    })


def scored(spark, n=4000):
    """Label is logistic in f1 only."""
    df = spark.range(n).withColumns({"f1": 6 * uniform("f1"), "f2": 6 * uniform("f2"), "t": hash_uniform("id", "t")})
    p = 1 / (1 + F.exp(-1.5 * F.col("f1")))
    return df.withColumns({"label": (F.col("t") < p).cast("double"), "score": F.round(p, 2)})
