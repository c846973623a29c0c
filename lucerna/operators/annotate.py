"""Blinded packets and merging of double annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import batch_plan
from .sampling import seeded_order


def first_filled(*cols: Column) -> Column:
    """P25: the first column that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def blind_id(salt: str, key: Column, seed: int) -> Column:
    """The first ten hex digits of a seeded hash."""
    return F.substr(F.sha2(F.concat_ws("|", F.lit(salt), key.cast("string"), F.lit(str(seed))), 256), F.lit(1), F.lit(10))


def blinded_packet(df: DataFrame, key: str, claims: str, seed: int, salt: str = "packet") -> tuple[DataFrame, DataFrame]:
    """(packet, key table): a row per claim, one NO-CLAIM row where there is none, blind ids, blank label columns.

    ``seeded_order`` of the blind id gives the order of the sheet; sort by ``sheet_order`` at the sink.
    """
    none = F.struct(F.lit("NO-CLAIM").alias("claim_id"), F.lit("").alias("text"))
    kept = F.transform(F.filter(claims, lambda c: c.isNotNull()), lambda c: F.struct(c["claim_id"].alias("claim_id"), F.coalesce(c["text"], F.lit("")).alias("text")))
    x = df.select(F.col(key), F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.array(none))).alias("c"))
    x = x.withColumn("blind_id", blind_id(salt, F.concat_ws("/", F.col(key).cast("string"), "c.claim_id"), seed))
    packet = x.select("blind_id", F.col("c.text").alias("claim"), seeded_order("blind_id", seed).alias("sheet_order"), F.lit("").alias("annotator_label"), F.lit("").alias("annotator_rationale"))
    return packet, x.select("blind_id", key, F.col("c.claim_id").alias("claim_id"))


def merge_annotations(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Both labels per key and where the key is missing; a full join so that nothing is lost."""
    x = a.select(key, F.col(label).alias("label_a"), F.lit(1).alias("_a")).join(b.select(key, F.col(label).alias("label_b"), F.lit(1).alias("_b")), key, "full")
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return x.select(key, "label_a", "label_b", side.alias("found_in"), (F.col("label_a") == F.col("label_b")).alias("agree"))


def valid_candidates(df: DataFrame, text: str, source: str) -> DataFrame:
    """Candidates that are not blank and differ from their source without regard to case."""
    return df.where((F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & ~F.coalesce(F.lower(F.col(text)) == F.lower(F.col(source)), F.lit(False)))


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each composite key in a total order, kept map-side."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("x")).select(*keys, "x.*")


def adversarial_candidates(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The valid candidates, numbered ADV-0001.. in the order of ``key`` (a distributed numbering)."""
    n = batch_plan(valid_candidates(df, text, source), key).withColumnRenamed("job_order", "_n").drop("batch_index")
    return n.withColumn("candidate_id", F.concat(F.lit("ADV-"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(4), F.length(F.col("_n").cast("string"))), F.lit("0")))).drop("_n")
