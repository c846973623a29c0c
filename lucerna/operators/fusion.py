"""Combining and comparing rankings.

Rankings are long tables (method, q, item, rank[, score]).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace
from .lexical import top_k


def reciprocal_rank_fusion(rankings: DataFrame, constant: int = 60, depth: int = 100, k: int = 100) -> DataFrame:
    """(q, item, score, rank): sum over methods of 1/(constant + rank), ranks beyond ``depth`` left out."""
    s = rankings.where(F.col("rank") <= depth).groupBy("q", "item").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return top_k(s, "q", "item", "score", k)


def overlap_at(rankings: DataFrame, a: str, b: str, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(q, overlap_at_k ..., same_top1): share of the first k items two methods have in common; always divided by k."""
    r = rankings.where(F.col("method").isin(a, b) & (F.col("rank") <= max(ks)))
    pair = r.groupBy("q", "item").agg(F.max("rank").alias("worst"), F.count_distinct("method").alias("n"))
    both = F.col("n") == 2
    cols = [(F.count_if(both & (F.col("worst") <= k)) / F.lit(float(k))).alias(f"overlap_at_{k}") for k in ks]
    return pair.groupBy("q").agg(*cols, F.max(F.when(both & (F.col("worst") == 1), 1).otherwise(0)).alias("same_top1"))


def margins(rankings: DataFrame) -> DataFrame:
    """(method, q, top1, margin): first score, and first less second (0 if there is no second)."""
    one, two = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    return rankings.where("rank <= 2").groupBy("method", "q").agg(one.alias("top1"), F.coalesce(F.round(one - two, 8), F.lit(0.0)).alias("margin"))


def place_share(df: DataFrame, value: str, tie: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Place of a value among all, (place - 1)/(n - 1), ties in the order of ``tie``; 0 for a single row.

    Without ``by`` the whole table is ranked by a distributed sort: rows are range partitioned (and written, so that
    the ranges are the same for every reader), numbered inside the ranges, and the counts of the earlier ranges
    (one row per range) are added.
    """
    if by:
        w = Window.partitionBy(*by)
        n = F.count(F.lit(1)).over(w)
        return df.withColumn(name, F.when(n > 1, (F.row_number().over(w.orderBy(value, tie)) - 1) / (n - 1)).otherwise(0.0))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = df.repartitionByRange(parts, F.col(value).asc_nulls_first(), F.col(tie)).withColumn("_p", F.spark_partition_id())
    r = Workspace(df.sparkSession, "places").keep(r, "ranges")
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(F.col(value).asc_nulls_first(), tie)))
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))  # one row per range
    r = r.join(before, "_p")
    place = F.when(F.col("_all") > 1, (F.col("_i") + F.col("_b") - 1) / (F.col("_all") - 1)).otherwise(0.0)
    return r.withColumn(name, place).drop("_p", "_i", "_b", "_all")


def weighted_sum(parts: list[tuple[float, Column]]) -> Column:
    """a composite of weighted terms, e.g. .30(1-a) + .20(1-b) + ..."""
    return reduce(lambda x, y: x + y, [F.lit(w) * c for w, c in parts])


def rank_shifts(first: DataFrame, base: str, other: str, step: int = 3, none: int = 999) -> DataFrame:
    """(q, improves, hurts): does ``other`` find the first relevant item ``step`` places earlier or later?

    ``first`` is (method, q, first_rank) with null where nothing relevant was found.
    """
    def rank(m: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("method") == m, F.col("first_rank"))), F.lit(none))

    return first.groupBy("q").agg((rank(base) - rank(other) >= step).cast("int").alias("improves"), (rank(other) - rank(base) >= step).cast("int").alias("hurts"))


def rescued(first: DataFrame, base: str, k: int) -> DataFrame:
    """Per other method: queries the base misses at ``k`` and how many of them the method finds."""
    per = first.groupBy("q").agg(F.max(F.when(F.col("method") == base, F.coalesce(F.col("first_rank") <= k, F.lit(False)))).alias("hit"))
    missed = per.where(~F.col("hit")).select("q")
    rest = first.where(F.col("method") != base).join(missed, "q")
    return rest.groupBy("method").agg(F.count_distinct("q").alias("n_missed"), F.count_if(F.coalesce(F.col("first_rank") <= k, F.lit(False))).alias("n_rescued"))


def best_method(first: DataFrame, cost: dict[str, int], none: int = 999) -> DataFrame:
    """Per query the method with the earliest first relevant rank, the cheaper on ties."""
    table = F.create_map(*[F.lit(x) for kv in cost.items() for x in kv])
    return first.groupBy("q").agg(F.min_by("method", F.struct(F.coalesce("first_rank", F.lit(none)), F.coalesce(F.try_element_at(table, F.col("method")), F.lit(none)), F.col("method"))).alias("method"))
