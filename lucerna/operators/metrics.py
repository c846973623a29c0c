"""Quality metrics: retrieval, classification, agreement, rates, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_relevant(rankings: DataFrame, gold: DataFrame, depth: int = 20) -> DataFrame:
    """(method, q, first_rank) for every ranked query; null if nothing relevant stands within ``depth``."""
    g = gold.select("q", "item").distinct().withColumn("_rel", F.lit(True))
    r = rankings.where(F.col("rank") <= depth).select("method", "q", "item", "rank").join(g, ["q", "item"], "left")
    return r.groupBy("method", "q").agg(F.min(F.when(F.col("_rel"), F.col("rank"))).alias("first_rank"))


def hit_columns(ks: tuple[int, ...] = (1, 5, 10, 20)) -> list[Column]:
    """Hits at k and reciprocal rank from ``first_rank``."""
    hits = [F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias(f"hit_at_{k}") for k in ks]
    return [*hits, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr")]


def retrieval_summary(first: DataFrame, attributes: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Mean hits and MRR per method: overall and by each attribute, one pass of grouping sets.

    A grouping column is ``all`` where it is not grouped by.  Queries without attribute rows count as ``none``.
    """
    t = first.join(attributes, "q", "left").select("method", *[F.coalesce(F.col(c), F.lit("none")).alias(c) for c in by], *hit_columns(ks))
    sets = [[F.col("method")], *[[F.col("method"), F.col(c)] for c in by]]
    means = [F.round(F.avg(f"hit_at_{k}"), 6).alias(f"hit_at_{k}") for k in ks] + [F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("n")]
    return t.groupingSets(sets, "method", *by).agg(*means).select("method", *[F.coalesce(F.col(c), F.lit("all")).alias(c) for c in by], *[f"hit_at_{k}" for k in ks], "mrr", "n")


def macro_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of the groups' means; null for no rows."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("macro_mean"), F.count(F.lit(1)).alias("n_groups"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row per actual label of the fixed set, one column per predicted label."""
    known = df.where(F.col(actual).isin(labels) & F.col(predicted).isin(labels))
    return known.groupBy(F.col(actual).alias("actual")).agg(*[F.count_if(F.col(predicted) == x).alias(f"pred_{x}") for x in labels])


def per_class(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """Tp, fp, fn, support, precision, recall and F1 per label; null where undefined.

    One pass: each row is counted for its actual and its predicted label.
    """
    known = df.where(F.col(actual).isin(labels) & F.col(predicted).isin(labels))
    both = F.array(F.struct(F.col(actual).alias("label"), F.lit(True).alias("is_actual")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_actual")))
    x = known.select((F.col(actual) == F.col(predicted)).alias("same"), F.explode(both).alias("e")).select("same", "e.*")
    c = x.groupBy("label").agg(
        F.count_if(F.col("is_actual") & F.col("same")).alias("tp"), F.count_if(~F.col("is_actual") & ~F.col("same")).alias("fp"), F.count_if(F.col("is_actual") & ~F.col("same")).alias("fn")
    )
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("support", F.col("tp") + F.col("fn")).withColumn("_p", p).withColumn("_r", r)
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return c.select("label", "tp", "fp", "fn", "support", F.round("_p", 6).alias("precision"), F.round("_r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def averaged_f1(classes: DataFrame) -> DataFrame:
    """Macro F1 over classes with support and a defined F1, and F1 weighted by support."""
    seen = classes.where((F.col("support") > 0) & F.col("f1").isNotNull())
    return seen.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"))


def agreement(df: DataFrame, a: str, b: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with both labels, percent agreement, Cohen's kappa (1 if chance agreement is 1, null on no rows), and the
    false positives of the first label: rows that only ``b`` gives it, and their share of those ``b`` gives it to."""
    known = df.where(F.col(a).isin(labels) & F.col(b).isin(labels))
    false = F.count_if((F.col(b) == labels[0]) & (F.col(a) != labels[0])).alias("n_false")
    sums = [false] + [F.count_if(F.col(a) == x).alias(f"a{i}") for i, x in enumerate(labels)] + [F.count_if(F.col(b) == x).alias(f"b{i}") for i, x in enumerate(labels)]
    g = known.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), *sums)
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    po = F.col("same") / n
    pe = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(1, len(labels))), F.col("a0") * F.col("b0")) / (n * n)
    kappa = F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    return g.select(*(by or []), "n", (F.col("n") - F.col("same")).alias("n_disagree"), F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"), "n_false", F.round(F.try_divide(F.col("n_false"), F.col("b0")), 6).alias("false_rate"))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, min, median, mean, p90 (linear interpolation) and max of the non-null values."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.9)), 6).alias("p90"), F.max(v).alias("max")
    )


def paired_difference(df: DataFrame, key: str, condition: str, value: str, a: str, b: str) -> DataFrame:
    """One row: pairs that have both conditions, mean of a - b, share of wins of a (ties count half)."""
    p = df.groupBy(key).agg(F.max(F.when(F.col(condition) == a, F.col(value))).alias("a"), F.max(F.when(F.col(condition) == b, F.col(value))).alias("b")).where("a is not null and b is not null")
    d = F.col("a") - F.col("b")
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(d), 6).alias("mean_difference"), F.round(F.avg(F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)), 6).alias("win_share"))


def map_totals(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Sum per key of an open-ended numeric map."""
    return df.select(*(by or []), F.explode(column).alias("name", "value")).groupBy(*(by or []), "name").agg(F.round(F.sum("value"), 6).alias("total"), F.count("value").alias("n"))


def rates(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows, and for each condition how many rows meet it and their share; null does not meet; one pass."""
    met = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    cols = [x for n, c in met.items() for x in (F.count_if(c).alias(f"n_{n}"), F.round(F.avg(c.cast("double")), 6).alias(f"{n}_rate"))]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *cols)


def mean_size(df: DataFrame, array: str, by: list[str] | None = None) -> DataFrame:
    """Rows and the mean number of elements; a null array counts as empty."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.size(array), F.lit(0)).cast("double")), 6).alias("mean_size"))


def distinct_combinations(df: DataFrame, columns: list[Column]) -> DataFrame:
    """How many rows and how many different combinations of the columns; nulls are values like any other."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*columns)).alias("n_distinct"))


def pivot_values(df: DataFrame, key: str, condition: str, value: str, conditions: list[str]) -> DataFrame:
    """One row per key with a column for each condition (its greatest value), any number of them, from one grouping."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(condition) == c, F.col(value))).alias(c) for c in conditions])


def largest_differences(df: DataFrame, key: str, a: Column, b: Column, n: int = 6) -> DataFrame:
    """The ``n`` rows with the largest absolute difference, ties to the smaller key; rows without one are left out."""
    d = df.select(key, (a - b).alias("difference")).where("difference is not null")
    return d.orderBy(F.desc(F.abs("difference")), F.asc(key)).limit(n)
