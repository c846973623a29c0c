"""Snippet bank, gold map and corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_key, squeeze
from .skew import heavy_keys, salted_join


def is_blank(c: Column, kind: str) -> Column:
    """Null, blank text or an empty list."""
    if kind.startswith("array") or kind.startswith("map"):
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return c.isNull() | (F.trim(c) == "")
    return c.isNull()


def missing_fields(df: DataFrame) -> DataFrame:
    """(field, n_missing, n) for every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_blank(F.col(c), k)).alias(f"m_{i}") for i, (c, k) in enumerate(df.dtypes)])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m_{i}").alias("n_missing")) for i, c in enumerate(df.columns)])
    return counts.select("n", F.explode(pairs).alias("x")).select("x.field", "x.n_missing", "n")


def snippet_bank(rows: DataFrame, text: str, docs: str, order: str) -> DataFrame:
    """One row per normalised text: key, text of the first row in ``order``, occurrences, number of documents.

    Blank and null texts are rejected (``rejected`` counts them).  The documents themselves are rows of
    ``snippet_documents``, never a list.
    """
    r = rows.where(~is_blank(F.col(text), "string")).select(content_key(F.col(text)).alias("snippet_key"), F.trim(F.col(text)).alias("text"), F.col(docs).alias("docs"), F.col(order).alias("_o"))
    g = r.groupBy("snippet_key").agg(F.min_by("text", F.struct("_o", "text")).alias("text"), F.count(F.lit(1)).alias("occurrences"))
    d = r.select("snippet_key", F.explode("docs").alias("d")).where("d is not null").distinct().groupBy("snippet_key").agg(F.count(F.lit(1)).alias("n_documents"))
    return g.join(d, "snippet_key", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def snippet_documents(rows: DataFrame, text: str, docs: str) -> DataFrame:
    """(snippet_key, document_id): the documents of each normalised text."""
    r = rows.where(~is_blank(F.col(text), "string")).select(content_key(F.col(text)).alias("snippet_key"), F.explode(docs).alias("document_id"))
    return r.where("document_id is not null").distinct()


def rejected(rows: DataFrame, text: str) -> DataFrame:
    """Rows kept and rejected for a blank or null text."""
    blank = is_blank(F.col(text), "string")
    return rows.agg(F.count_if(~blank).alias("n_kept"), F.count_if(blank).alias("n_rejected"))


def duplicate_groups(df: DataFrame, value: str, member: str) -> DataFrame:
    """A4: values held by several rows: how many, first and last member; ``duplicate_members`` names all of them."""
    v = squeeze(F.col(value))
    return df.where(F.col(value).isNotNull()).groupBy(F.sha2(v, 256).alias("group_key")).agg(F.count(F.lit(1)).alias("n_members"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n_members > 1")


def duplicate_members(df: DataFrame, value: str, member: str) -> DataFrame:
    """A4: (group_key, member, place): every row of every value that several rows hold, numbered within its group."""
    d = df.where(F.col(value).isNotNull()).select(F.sha2(squeeze(F.col(value)), 256).alias("group_key"), F.col(member).alias("member"))
    many = d.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_key")
    m = salted_join(d, many, ["group_key"], "left_semi", heavy_keys(d, "group_key"), F.col("member"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("group_key").orderBy("member")))


def report_lists(members: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` members of each group as one text, for a report; only those are gathered."""
    first = members.where(F.col("place") <= n).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("place", "member"))).alias("m"))
    return first.select("group_key", F.array_join(F.transform("m", lambda x: x["member"].cast("string")), ",").alias("members"))


def duplicate_occurrences(df: DataFrame, value: str) -> DataFrame:
    """A3/A5: rows, distinct normal forms and the surplus."""
    k = F.sha2(squeeze(F.col(value)), 256)
    return df.agg(F.count(k).alias("n"), F.count_distinct(k).alias("n_distinct")).withColumn("n_surplus", F.col("n") - F.col("n_distinct"))


def gold_map(links: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, place): the distinct items of each key in order, one row each; repeats go map-side."""
    d = links.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item).distinct()
    return d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(item)))


def dangling(links: DataFrame, targets: DataFrame, item: str, key: str) -> DataFrame:
    """(n_links, n_dangling): links whose item is in no row of ``targets``."""
    known = targets.select(F.col(key).alias(item)).where(F.col(item).isNotNull()).distinct().withColumn("_known", F.lit(True))
    l = links.where(F.col(item).isNotNull()).select(item).withColumn("_spread", F.monotonically_increasing_id())
    return salted_join(l, known, [item], "left", heavy_keys(l, item), F.col("_spread")).agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("_known").isNull()).alias("n_dangling"))
