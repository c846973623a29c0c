"""Session factory and table loading (S11 profile included)."""

from __future__ import annotations

import os
import platform
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lucerna", cores: int | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster spark-submit brings its own.

    UTC, AQE with skew splitting on, shuffle partitions equal to the cores.  ``checkpoint_dir``: where intermediate tables go.
    """
    n = cores or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environment_profile(spark: SparkSession) -> DataFrame:
    """One row describing the runtime of the driver: versions, cores, memory, free disk, installed packages."""
    from importlib import metadata

    sc = spark.sparkContext
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else None
    packages = sorted({f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions() if d.metadata["Name"]})
    row = (spark.version, platform.python_version(), platform.platform(), sc.master, int(sc.defaultParallelism), os.cpu_count(), memory, shutil.disk_usage(os.getcwd()).free, packages)
    schema = "spark_version string, python_version string, system string, master string, parallelism int, cores int, memory_bytes bigint, free_disk_bytes bigint, packages array<string>"
    return spark.createDataFrame([row], schema).withColumn("session_time_zone", F.lit(spark.conf.get("spark.sql.session.timeZone")))


def stamped(df: DataFrame, name: str = "run_at") -> DataFrame:
    """``df`` with the time of the query, the same on every row."""
    return df.withColumn(name, F.current_timestamp())
