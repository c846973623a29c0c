"""Work units: signatures, deduplicated jobs, batches, resume, last write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace


def signature(*parts: Column) -> Column:
    """SHA-256 over the parts, arrays joined by commas, nulls as a mark of their own."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("\u0001")) for p in parts]), 256)


def job_id(sig: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substr(sig, F.lit(1), F.lit(16))))


def dedup_jobs(arms: DataFrame, sig: str, arm: str, condition: str) -> DataFrame:
    """One job per signature: number of arms, first arm, its conditions (a small set); ``job_arms`` links the arms."""
    return arms.groupBy(sig).agg(F.count_distinct(arm).alias("n_arms"), F.min(arm).alias("first_arm"), F.array_sort(F.collect_set(condition)).alias("conditions"))


def job_arms(arms: DataFrame, sig: str, arm: str) -> DataFrame:
    """(signature, arm): every arm with its job, once each."""
    return arms.select(sig, arm).distinct()


def batch_plan(jobs: DataFrame, order: str, size: int = 6) -> DataFrame:
    """``job_order`` from 1 in the total order of ``order`` and ``batch_index`` = ceil(job_order/size).

    The numbering is a distributed sort: ranges are written once, numbered inside and offset by the counts of the
    earlier ones.
    """
    parts = max(1, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = Workspace(jobs.sparkSession, "batches").keep(jobs.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "ranges")
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    n = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row per range
    r = r.join(n, "_p").withColumn("job_order", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")
    return r.withColumn("batch_index", F.ceil(F.col("job_order") / F.lit(size)))


def fan_out(arms: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each arm with the result of its job; arms without a result are dropped."""
    return arms.join(results, key)


def last_written(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest record of each key; ``max_by`` keeps one row per key map-side."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(key, "x.*")


def remaining(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs not completed yet."""
    return jobs.join(done.select(key), key, "left_anti")


def reuse(wanted: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Wanted rows with the cached value and whether it must be computed."""
    c = cache.select(key, value).groupBy(key).agg(F.min(value).alias(value))
    return wanted.join(c, key, "left").withColumn("must_compute", F.col(value).isNull())


def request_groups(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """Rows that share a request: how many items, first and last; ``request_items`` keeps the items."""
    return rows.groupBy(*by).agg(F.count(item).alias("n_items"), F.min(item).alias("first_item"), F.max(item).alias("last_item"))


def request_items(rows: DataFrame, by: list[str], item: str, size: int = 20) -> DataFrame:
    """(by, item, place, part): every item with its place in its request; requests of more than ``size`` items are
    sent in parts, so no request grows with the data."""
    x = rows.select(*by, item).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(item)))
    return x.withColumn("part", F.ceil(F.col("place") / F.lit(size)))
