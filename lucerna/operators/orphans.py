"""References to records that do not exist (orphans), with validity in time.

Two parts, both free of per-key collection:

* ``resolve_in_time``: does the key a reference names have a row valid at the time of the
  reference?  The lifetimes of each key are merged to disjoint intervals and looked up with
  the key; keys that were retired and came back very often are cut by calendar month.
* ``composite_orphans``: references with composite, partly null keys.  They are grouped by
  their null mask and each group is looked up on its non-null columns alone, under the
  declared match semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import heavy_keys, salted_join, union_all

MATCH = ("simple", "full", "partial")
_FOREVER = "timestamp_ntz'9999-12-31 00:00:00'"


def month_number(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def lifetimes(targets: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the disjoint times in which some row of the key is valid.

    A row is valid from ``start`` (inclusive) up to ``end`` (exclusive; null: for ever).
    Rows without key or start, or that end before they start, are never valid.
    Deliveries with the same start are combined map-side before the window sees them.
    """
    t = targets.select(
        F.col(key).alias("key"), F.col(start).cast("timestamp_ntz").alias("s"), F.coalesce(F.col(end).cast("timestamp_ntz"), F.expr(_FOREVER)).alias("e")
    ).where("key is not null and s is not null and e > s")
    t = t.groupBy("key", "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("fresh", F.when(F.col("s") > F.max("e").over(before), 1).otherwise(0))
    t = t.withColumn("island", F.sum("fresh").over(upto))
    return t.groupBy("key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def resolve_in_time(
    refs: DataFrame, key: str, time: str, targets: DataFrame, tkey: str, start: str, end: str, salt_with: str, carry: list[str], inline: int = 64
) -> DataFrame:
    """``refs`` columns ``carry``, key and time, with ``reason``: null where a row of the key is valid at the time.

    Otherwise ``missing`` (no row of the key, or the reference has no key), ``late`` (all rows begin
    after the time) or ``deleted``.  A reference without time is resolved if its key exists at all.
    One shuffle of the references: each key brings its disjoint lifetimes along.  Keys with more than
    ``inline`` of them (if there are any) take a second look-up by (key, month) instead.
    """
    heavy = heavy_keys(refs, key)
    t = F.col("_t")
    r = refs.withColumn("_t", F.col(time).cast("timestamp_ntz"))
    live = lifetimes(targets, tkey, start, end).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    first = targets.where(F.col(tkey).isNotNull()).groupBy(F.col(tkey).alias("key")).agg(F.min(F.col(start).cast("timestamp_ntz")).alias("_first"))
    short = live.groupBy("key").agg(F.collect_list(F.when(F.col("n") <= inline, F.struct("s", "e"))).alias("_live"), F.first("n").alias("_n"))
    known = first.join(short, "key", "left").withColumnRenamed("key", key).withColumn("_has", F.lit(True))
    r = salted_join(r, known, [key], "left", heavy, F.col(salt_with))
    ok = F.coalesce(F.exists("_live", lambda i: (i["s"] <= t) & (t < i["e"])), F.lit(False))
    reason = F.when(F.col("_has").isNull(), "missing").when(ok | t.isNull(), F.lit(None).cast("string")).when(t < F.col("_first"), "late").otherwise("deleted")
    cols = [*carry, key, time]
    if live.where(F.col("n") > inline).limit(1).count() == 0:
        return r.select(*cols, reason.alias("reason"))
    many = F.coalesce(F.col("_n") > inline, F.lit(False))
    lo, hi = refs.select(month_number(F.col(time).cast("timestamp_ntz")).alias("m")).agg(F.min("m"), F.max("m")).first()
    cut = live.where(F.col("n") > inline)
    cut = cut.withColumn("a", F.greatest(month_number(F.col("s")), F.lit(lo or 0))).withColumn("b", F.least(month_number(F.col("e")), F.lit(hi or 0))).where("a <= b")
    cut = cut.withColumn("_m", F.explode(F.sequence("a", "b"))).groupBy(F.col("key").alias(key), "_m").agg(F.collect_list(F.struct("s", "e")).alias("_live"))
    rest = salted_join(r.where(many).drop("_live").withColumn("_m", month_number(t)), cut, [key, "_m"], "left", heavy, F.col(salt_with))
    return r.where(~many).select(*cols, reason.alias("reason")).unionByName(rest.select(*cols, reason.alias("reason")))


def null_masks(df: DataFrame, cols: list[str]) -> list[tuple[bool, ...]]:
    """The null masks (True: null) that occur in ``cols``: at most 2^k rows of a map-side combined aggregation."""
    rows = df.select(*[F.col(c).isNull().alias(f"m{i}") for i, c in enumerate(cols)]).distinct().collect()
    return sorted(tuple(r) for r in rows)


def composite_match(
    refs: DataFrame, targets: DataFrame, cols: list[str], match: str = "simple", masks: list[tuple[bool, ...]] | None = None, salt_with: str | None = None, heavy: list | None = None
) -> DataFrame:
    """``refs`` with ``matched``: does the composite key ``cols`` occur in ``targets``?  Null: it is no reference.

    ``match``: ``simple``: a key with any null is no reference; ``full``: all null is no reference and
    partly null matches nothing; ``partial``: the non-null columns must occur together in some target row.
    ``masks``: the null masks to expect (default: those that occur in ``refs``).  ``heavy`` values of the
    first column are salted.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    groups = []
    for mask in masks if masks is not None else null_masks(refs, cols):
        here = refs
        for c, null in zip(cols, mask):
            here = here.where(F.col(c).isNull() if null else F.col(c).isNotNull())
        if all(mask) or (any(mask) and match == "simple"):
            groups.append(here.withColumn("matched", F.lit(None).cast("boolean")))
            continue
        if any(mask) and match == "full":
            groups.append(here.withColumn("matched", F.lit(False)))
            continue
        present = [c for c, null in zip(cols, mask) if not null]
        known = targets.select(*present).dropna().distinct().withColumn("_hit", F.lit(True))
        spread = heavy if heavy and salt_with and not mask[0] else []
        joined = salted_join(here, known, present, "left", spread, F.col(salt_with or cols[0]), heavy_col=cols[0])
        groups.append(joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).select(*refs.columns, "matched"))
    return union_all(groups) if groups else refs.withColumn("matched", F.lit(None).cast("boolean"))


def composite_orphans(refs: DataFrame, targets: DataFrame, cols: list[str], match: str = "simple", **kw) -> DataFrame:
    """Rows of ``refs`` whose composite key refers to something and matches no row of ``targets``."""
    return composite_match(refs, targets, cols, match, **kw).where(~F.col("matched")).drop("matched")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per source table, field, month and reason."""
    return orphans.groupBy("src_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
