"""Session helpers: a default local session, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIVATE: dict[str, str] = {}


def get_session(app: str = "sparkmetrica", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; on a cluster use its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, kind: str = "settled") -> str:
    """A new folder that the driver and all executors see, below the cluster's ``spark.checkpoint.dir``; it goes when the session ends.

    A private folder is made only in local mode and only where that setting is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or PRIVATE.get("folder")
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = PRIVATE["folder"] = tempfile.mkdtemp(prefix="sparkmetrica-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    folder = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    system, path = file_system(spark, folder)
    system.deleteOnExit(path)
    return folder


def file_system(spark: SparkSession, folder: str):
    """The file system of a folder and the folder as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: written as Parquet to a shared folder and read back.

    Used where a table feeds several jobs, or where block numbers must not
    change if a lost executor makes Spark run a stage again. The table read back has the size of its files
    for the optimiser; a checkpoint keeps the estimate of the plan that made it, and such estimates multiply in every
    join until planning itself takes the driver's memory.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    names = [f"c{i}" for i in range(len(df.columns))]  # Parquet takes no names that differ in case only
    kept = df.toDF(*names)
    kept = kept.select(*[c for c, kind in kept.dtypes if kind != "void"])
    kept.write.parquet(folder)
    back = spark.read.schema(kept.schema).parquet(folder)
    out = back.select(*[F.col(c) if c in back.columns else F.lit(None).alias(c) for c in names]).toDF(*df.columns)
    out.settled_in = folder
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables that :func:`settle` has written, once nothing reads them any more."""
    for df in frames:
        if df is not None:
            system, path = file_system(df.sparkSession, df.settled_in)
            system.delete(path, True)
