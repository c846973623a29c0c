"""Grouped splits, stratified and quota samples, look-ups in list order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded_order(key: str, seed: int) -> Column:
    """U8/Q17: a reproducible shuffle order that SQL can repeat."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each stratum in seeded order."""
    w = Window.partitionBy(stratum).orderBy(seeded_order(key, seed), key)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def pool_cascade(df: DataFrame, by: str, pools: list[tuple[str, Column, list[Column]]], n: int) -> DataFrame:
    """T5: up to ``n`` rows per ``by``: each row belongs to the first pool whose condition holds; pools in order, rows
    within a pool in its own order."""
    tagged = None
    for i, (name, cond, order) in enumerate(pools):
        part = df.withColumn("_pool", F.lit(i)).withColumn("selection_reason", F.lit(name))
        earlier = [c for _, c, _ in pools[:i]]
        mine = F.coalesce(cond, F.lit(False))
        for c in earlier:
            mine = mine & ~F.coalesce(c, F.lit(False))
        w = Window.partitionBy(by).orderBy(*order)
        part = part.where(mine).withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= n)
        tagged = part if tagged is None else tagged.unionByName(part)
    w = Window.partitionBy(by).orderBy("_pool", "_o")
    return tagged.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).drop("_pool", "_o")


def pick_with_control(df: DataFrame, cell: list[str], key: str, first: list[Column], control: list[Column]) -> DataFrame:
    """Per cell the best row by one order and the best of the rest by another (role pick / control).

    The control is among the best two by its order, so both choices keep at most two rows of a cell before the shuffle.
    A cell of one row has no control.  ``key`` is unique and not null.
    """
    w = Window.partitionBy(*cell)
    pick = df.withColumn("_r", F.row_number().over(w.orderBy(*first, F.col(key)))).where("_r = 1").drop("_r").withColumn("role", F.lit("pick"))
    two = df.withColumn("_r", F.row_number().over(w.orderBy(*control, F.col(key)))).where("_r <= 2")
    rest = two.join(pick.select(key), key, "left_anti")
    other = rest.withColumn("_o", F.row_number().over(w.orderBy("_r"))).where("_o = 1").drop("_r", "_o").withColumn("role", F.lit("control"))
    return pick.unionByName(other)


def ordered_lookup(ids: DataFrame, source: DataFrame, order: str, key: str) -> DataFrame:
    """The source's rows for a list of ids, (order, key, found, source columns): the list's order stays, an id that the
    source lacks has ``found`` false and nulls.  Sort by ``order`` at the sink."""
    s = source.withColumn("found", F.lit(True))
    return ids.select(order, key).join(s, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def id_list(spark: SparkSession, ids: list[str], order: str = "place", key: str = "id") -> DataFrame:
    """A literal list as a table (order from 1, id)."""
    return spark.createDataFrame(list(enumerate(ids, 1)), f"{order} int, {key} string")


def allowed_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The public view of a table: only columns on the list, in its order; what is not there is not invented."""
    return df.select(*[c for c in allowed if c in df.columns])


def best_combination(options: DataFrame, group: str, key: str, feature: str, targets: dict[str, int], per_group: int = 6) -> DataFrame:
    """One option per group so that the counts of a feature come nearest the targets (L1), ties to the smaller keys.

    At most ``per_group`` options of each group take part; groups are a fixed small set, so the product is bounded.
    """
    w = Window.partitionBy(group).orderBy(key)
    o = options.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group)
    groups = [r[0] for r in o.select(group).distinct().orderBy(group).collect()]
    acc = None
    for g in groups:
        part = o.where(F.col(group) == g).select(F.array(F.struct(F.lit(g).alias("g"), F.col(key).alias("k"), F.col(feature).alias("f"))).alias("new"))
        acc = part.select(F.col("new").alias("chosen")) if acc is None else acc.join(part).select(F.concat("chosen", "new").alias("chosen"))

    if acc is None:  # no group, no choice
        return o.select(F.lit(0).alias("distance"), group, key, feature)

    def count(v: str) -> Column:
        return F.size(F.filter("chosen", lambda x: x["f"] == v))

    dist = sum((F.abs(count(v) - n) for v, n in targets.items()), F.lit(0))
    best = acc.select("chosen", dist.alias("distance"), F.transform("chosen", lambda x: x["k"]).alias("_k")).orderBy("distance", "_k").limit(1)
    return best.select("distance", F.explode("chosen").alias("x")).select("distance", F.col("x.g").alias(group), F.col("x.k").alias(key), F.col("x.f").alias(feature))


def greedy_split(df: DataFrame, stratum: str, group: str, seed: int, shares: tuple[float, float] = (0.70, 0.15), names: tuple[str, str, str] = ("train", "dev", "test"), pinned: str | None = None) -> DataFrame:
    """Split of each (stratum, group): groups in seeded order go where the relative deficit is largest.

    Ties: absolute deficit, then the order of ``names``.  Groups with a true ``pinned`` go to dev first.  Targets are
    rounded half to even.  Only one row per group (its size) reaches the per-stratum function, in shuffle order.
    """
    import pandas as pd

    pin = F.max(F.coalesce(F.col(pinned).cast("boolean"), F.lit(False))) if pinned else F.lit(False)
    g = df.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("n"), pin.alias("pin")).withColumn("o", F.xxhash64(F.col(group).cast("string"), F.lit(seed)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pin", "o", group], ascending=[False, True, True], kind="stable")
        total = int(pdf["n"].sum())
        target = [round(shares[0] * total), round(shares[1] * total)]
        target.append(total - sum(target))
        have, out = [0, 0, 0], []
        for n, p in zip(pdf["n"], pdf["pin"]):
            i = 1 if p else max(range(3), key=lambda k: ((target[k] - have[k]) / max(target[k], 1), target[k] - have[k], -k))
            have[i] += int(n)
            out.append(names[i])
        return pdf[[stratum, group]].assign(split=out)

    kinds = dict(df.dtypes)
    return g.groupBy(stratum).applyInPandas(run, f"{stratum} {kinds[stratum]}, {group} {kinds[group]}, split string")


def hash_split(key: Column, shares: tuple[float, float] = (0.70, 0.15), names: tuple[str, str, str] = ("train", "dev", "test")) -> Column:
    """The scalable form: the split is a function of the group's key alone, so it needs no shuffle and never changes."""
    x = F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return F.when(x < shares[0], names[0]).when(x < sum(shares), names[1]).otherwise(names[2])


def split_overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that stand in two splits, per pair of splits."""
    s = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_keys"))


def leaking_values(df: DataFrame, split: str, value: Column) -> DataFrame:
    """Normal forms that stand in more than one split, with rows and splits."""
    return df.groupBy(value.alias("value_key")).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")
