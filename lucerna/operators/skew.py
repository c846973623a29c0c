"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, least: int = 20_000) -> list:
    """Values of ``key`` that hold at least ``share`` of all rows (and ``least`` rows).

    At most ``1/share`` values can qualify, so the list that reaches the driver is bounded.
    Counting is a map-side combined aggregation over the one column.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    top = counts.orderBy(F.desc("_n")).limit(int(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [r[0] for r in top if r["_n"] >= share * total]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    heavy: list,
    salt_with: Column,
    heavy_col: str | None = None,
    ways: int = 24,
) -> DataFrame:
    """Join on ``on``; rows of ``left`` with a heavy value of ``heavy_col`` are spread ``ways`` fold.

    The matching rows of ``right`` are repeated ``ways`` times, so ``right`` should hold few
    rows for each key.  Without heavy keys this is the plain join.
    ``how`` may be inner, left, left_semi or left_anti.
    """
    if not heavy:
        return left.join(right, on, how)
    by = heavy_col or on[0]

    def hot(c: Column) -> Column:
        return F.coalesce(c.isin(heavy), F.lit(False))

    l = left.withColumn("_salt", F.when(hot(F.col(by)), F.pmod(F.xxhash64(salt_with), F.lit(ways)).cast("int")).otherwise(F.lit(0)))
    all_salts = F.sequence(F.lit(0), F.lit(ways - 1))
    r = right.withColumn("_salt", F.explode(F.when(hot(F.col(by)), all_salts).otherwise(F.array(F.lit(0)))))
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
