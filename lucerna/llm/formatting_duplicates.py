"""Records equal but for whitespace, case, punctuation, field order: one each, with the number of copies.

Dictionary encoding: every column's distinct raw values are brought to canonical tokens once,
each distinct token gets an integer, records are rewritten as sorted integer tuples and equal
tuples are grouped.  Text is shuffled once, to find the distinct raw values; after that raw values
and tokens travel as 128-bit digests and records as short arrays of integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join, union_all
from ..workspace import Workspace


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of a text, lower case, nothing else."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def body_token(c: Column) -> Column:
    """One token; a null text is a value of its own, unlike an empty one."""
    return F.array(F.coalesce(F.concat(F.lit("="), letters_and_digits(c)), F.lit("null")))


def set_tokens(c: Column) -> Column:
    """The distinct entries of an array; null and empty array are the same empty set, a null entry is none."""
    return F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def json_tokens(c: Column) -> Column:
    """A token for each top-level field: its name and canonical value (nested objects by sorted keys, no spacing).

    Text that is no JSON object is one token of its own; null is the empty object.
    """
    v = F.try_parse_json(c)
    m = F.try_variant_get(v, "$", "map<string, variant>")
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.coalesce(pairs, F.when(c.isNotNull(), F.array(F.concat(F.lit("?"), F.trim(c)))), F.array().cast("array<string>"))


def _digest(c: Column) -> Column:
    """128 bits of a raw value of any type: what the join of records to the dictionary compares."""
    return F.unhex(F.md5(F.to_json(F.struct(c.alias("x"))))).alias("_m")


def encode(records: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]], ws: Workspace, share: float = 0.02) -> DataFrame:
    """(key, tuple): each record as a sorted array of integers, one for each distinct (column, token).

    The dictionary of a column holds its distinct raw values with their counts (combined map-side, so a
    value in a third of the rows costs one row per task).  Values that the counts show to hold ``share``
    of the rows, at most ``1/share`` for each column, are salted in the join back, and so are tokens that very many
    different raw values share.
    """
    out = records.select(key, *[F.col(c).alias(f"r{i}") for i, c in enumerate(columns)])
    raws = []
    for i, canon in enumerate(columns.values()):
        raw = out.groupBy(F.col(f"r{i}").alias("r")).agg(F.count(F.lit(1)).alias("rows"))
        tokens = F.transform(canon(F.col("r")), lambda t: F.unhex(F.md5(t)))
        raws.append(raw.select(F.lit(i).alias("col"), _digest(F.col("r")), "rows", tokens.alias("tokens")))
    raw = ws.keep(union_all(raws), "raw")
    total = raw.where("col = 0").agg(F.sum("rows")).first()[0] or 0
    heavy: dict[int, list] = {}
    for r in raw.where((F.col("rows") >= max(20_000, share * total))).select("col", "_m").collect():
        heavy.setdefault(r["col"], []).append(r["_m"])
    exploded = raw.select("col", "_m", F.explode("tokens").alias("token"))
    tokens = exploded.groupBy("col", "token").agg(F.count(F.lit(1)).alias("rows")).select("col", "token", "rows", F.monotonically_increasing_id().alias("n"))
    dictionary = ws.keep(tokens, "dictionary")  # written, so that every reader sees the same integers
    seen = dictionary.agg(F.sum("rows")).first()[0] or 0
    hot = [r[0] for r in dictionary.where(F.col("rows") >= max(20_000, share * seen)).select("token").collect()]  # at most 1/share
    numbered = salted_join(exploded, dictionary.select("col", "token", "n"), ["col", "token"], "inner", hot, F.col("_m"), heavy_col="token")
    coded = numbered.groupBy("col", "_m").agg(F.collect_set("n").alias("ns"))
    coded = ws.keep(coded, "coded")
    out = out.select(key, *[_digest(F.col(f"r{i}")).alias(f"m{i}") for i in range(len(columns))])  # no text from here on
    for i in range(len(columns)):
        part = coded.where(F.col("col") == i).select(F.col("_m").alias(f"m{i}"), F.col("ns").alias(f"n{i}"))
        out = salted_join(out, part, [f"m{i}"], "left", heavy.get(i, []), F.col(key)).drop(f"m{i}")
    none = F.array().cast("array<bigint>")
    ints = F.array_sort(F.flatten(F.array(*[F.coalesce(F.col(f"n{i}"), none) for i in range(len(columns))])))
    return out.select(key, ints.alias("tuple"))


def collapse(records: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]], share: float = 0.02) -> DataFrame:
    """(key, keep_id, copies): every record with the smallest key of its set of equals and the size of that set.

    Nulls have the meaning the canonical form of their column gives them; an empty table gives an empty one;
    rows that repeat a key count as copies of each other.
    """
    ws = Workspace(records.sparkSession, "formatting-duplicates")
    coded = ws.keep(encode(records, key, columns, ws, share), "tuples")
    sets = ws.keep(coded.groupBy("tuple").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("copies")), "sets")
    big = max(20_000, share * coded.count())
    heavy = [r[0] for r in sets.where(F.col("copies") >= big).select(F.xxhash64("tuple")).collect()]  # at most 1/share rows
    m = sets.where("copies > 1").withColumn("_t", F.xxhash64("tuple"))
    back = salted_join(coded.withColumn("_t", F.xxhash64("tuple")), m, ["_t", "tuple"], "left", heavy, F.col(key))
    return back.select(key, F.coalesce("keep_id", F.col(key)).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
