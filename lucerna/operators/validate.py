"""Named invariants over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, passed, n_failed): every row must satisfy each condition (null fails); one aggregation."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), (F.col(f"f{i}") == 0).alias("passed"), F.col(f"f{i}").alias("n_failed")) for i, n in enumerate(checks)])
    return agg.select(F.explode(rows).alias("x")).select("x.*")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def content_hash(df: DataFrame) -> DataFrame:
    """K8/Q14: one row (n_rows, content_hash) that depends on the rows alone, not on order, files or line ends.

    Each row's 64-bit hashes are summed in 128-bit decimals, so the sum is combined map-side and exact.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.reverse(row), F.lit(1)).alias("b"))
    wide = "decimal(38,0)"
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("a").cast(wide)).alias("a"), F.sum(F.col("b").cast(wide)).alias("b")).select("n_rows", F.sha2(F.concat_ws("|", "n_rows", "a", "b"), 256).alias("content_hash"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; reading a row that breaks the condition raises."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
