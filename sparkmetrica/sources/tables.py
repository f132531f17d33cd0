"""Reading and writing tables, and typing untyped ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Table ``name`` of ``folder``. CSV and JSON need an explicit ``schema``."""
    if fmt == "parquet":
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if schema is None:
        raise ValueError(f"reading {fmt} needs a schema")
    reader = spark.read.schema(schema)
    return reader.csv(f"{folder}/{name}.csv", header=True) if fmt == "csv" else reader.json(f"{folder}/{name}.json")


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by=()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def coerce(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Cast text columns to ``schema``: ``(clean, rejects)``.

    A row with a non-NULL text that does not cast is left out of ``clean`` and
    kept in ``rejects`` with the names of the offending columns.
    """
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    bad = {n: F.col(n).isNotNull() & c.isNull() for n, c in cast.items()}
    names = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]))
    any_bad = reduce(lambda a, b: a | b, bad.values())
    other = [c for c in df.columns if c not in cast]
    clean = df.where(~any_bad).select(*[c.alias(n) for n, c in cast.items()], *other)
    return clean, df.where(any_bad).withColumn("bad_columns", names)
