"""Evidence packets, claims and verifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import heavy_keys, salted_join
from .validate import require


def evidence_packets(df: DataFrame, key: str, ids: str, corpus: DataFrame, ckey: str, text: str, n: int = 5) -> DataFrame:
    """(key, packet, n_missing): the first ``n`` distinct listed ids that exist, numbered E1.. without gaps.

    The list is at most a few ids long per row, so the packet is bounded by the row itself.
    """
    p = df.select(F.col(key).alias("k"), F.posexplode(F.array_distinct(F.col(ids))).alias("pos", "sid")).where("sid is not null")
    c = corpus.where(F.col(ckey).isNotNull()).groupBy(F.col(ckey).alias("sid")).agg(F.min(text).alias("text"), F.lit(True).alias("known"))
    j = salted_join(p, c, ["sid"], "left", heavy_keys(p, "sid"), F.col("k"))  # popular snippets are spread
    found = j.where("known").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("pos"))).where(F.col("r") <= n)
    packet = F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("E"), F.col("r")).alias("evidence_id"), F.col("sid").alias("snippet_id"), "text")))
    lost = j.groupBy("k").agg(F.count_if(F.col("known").isNull()).alias("n_missing"))
    return lost.join(found.groupBy("k").agg(packet.alias("packet")), "k", "left").select(F.col("k").alias(key), "packet", "n_missing")


def verified_claims(claims: DataFrame, checks: DataFrame, on: list[str], statuses: list[str], default: str) -> DataFrame:
    """Every claim with its verdict; no verdict, or one outside ``statuses``, becomes the default."""
    s = F.lower(F.regexp_replace(F.trim(F.col("status")), r"[\s-]+", "_"))
    v = checks.select(*on, s.alias("status"))
    out = claims.join(v, on, "left")
    return out.withColumn("status", F.when(F.col("status").isin(statuses), F.col("status")).otherwise(default))


def renumbered_claims(claims: Column) -> Column:
    """Claims with text, renumbered C1.., importance critical or else supporting; empty list for null."""
    kept = F.filter(claims, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    importance = lambda c: F.when(F.lower(c["importance"]) == "critical", "critical").otherwise("supporting").alias("importance")
    one = lambda c, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("claim_id"), F.trim(c["text"]).alias("text"), importance(c))
    return F.coalesce(F.transform(kept, one), F.expr("cast(array() as array<struct<claim_id:string,text:string,importance:string>>)"))


def claim_links(ids: Column, allowed: Column, variant: Column | None = None) -> Column:
    """P20: the sorted distinct ids of a claim that are allowed; a claim of the variant ``text_only`` has no graph edges."""
    kept = F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.array_contains(allowed, x))))
    return kept if variant is None else F.when(variant == "text_only", F.array().cast("array<string>")).otherwise(kept)


def answer_complete(claims: Column, answer: Column) -> Column:
    """An answer with text whose claims all have an id and a text, no id twice."""
    ids = F.transform(claims, lambda c: F.concat_ws("/", c["variant"], c["claim_id"]))
    filled = F.forall(claims, lambda c: (F.trim(F.coalesce(c["text"], F.lit(""))) != "") & c["claim_id"].isNotNull())
    return F.coalesce((F.trim(answer) != "") & (F.size(claims) > 0) & filled & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def verification_complete(wanted: Column, given: Column) -> Column:
    """The verdicts name exactly the claims asked about."""
    return F.coalesce((F.size(F.array_except(wanted, given)) == 0) & (F.size(F.array_except(given, wanted)) == 0) & (F.size(given) > 0), F.lit(False))


def released_with_unsupported(results: DataFrame, verdicts: DataFrame, key: str, released: Column, status: str, good: str) -> DataFrame:
    """One row: results, released ones, and released ones with any verdict other than ``good``; no list is collected."""
    bad = verdicts.groupBy(key).agg(F.max(F.coalesce(F.col(status) != good, F.lit(True))).alias("_bad"))
    r = results.select(key, F.coalesce(released, F.lit(False)).alias("_released")).join(bad, key, "left")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("_released").alias("n_released"), F.count_if(F.col("_released") & F.coalesce("_bad", F.lit(False))).alias("n_released_unsupported"))


def strict_evidence(df: DataFrame, key: str, ids: str, corpus: DataFrame, ckey: str, text: str, n: int = 5) -> DataFrame:
    """(key, evidence_id, snippet_id, text) for rows that list exactly ``n`` different ids; reading raises if an id is unknown."""
    p = df.where(F.size(F.array_distinct(F.col(ids))) == n).select(F.col(key).alias("k"), F.posexplode(ids).alias("pos", "sid"))
    c = corpus.where(F.col(ckey).isNotNull()).groupBy(F.col(ckey).alias("sid")).agg(F.min(text).alias("text"), F.lit(True).alias("known"))
    j = salted_join(p, c, ["sid"], "left", heavy_keys(p, "sid"), F.col("k"))
    j = require(j, F.col("known"), "an evidence id is in no row of the corpus")
    return j.select(F.col("k").alias(key), F.concat(F.lit("E"), F.col("pos") + 1).alias("evidence_id"), F.col("sid").alias("snippet_id"), "text")


def issue_codes(rules: dict[str, Column]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in rules.items()]))


def reply_claims(reply: Column, variant: str) -> Column:
    """U16: the verification list of a variant in a raw JSON reply, under either of its names; null if there is none."""
    v = F.try_parse_json(reply)
    kind = "array<struct<claim_id:string,status:string,evidence_ids:array<string>,brief_rationale:string>>"
    return F.coalesce(F.try_variant_get(v, f"$.{variant}.verifications", kind), F.try_variant_get(v, f"$.{variant}.claims", kind))


def status_counts(df: DataFrame, by: list[str], status: str, statuses: list[str]) -> DataFrame:
    """Rows per status as columns, one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses])
