"""Mixing sources to target weights by capped water-filling.

Only one row per source reaches the driver.  Whole repetitions take every document; the fractional one
takes seeded hash buckets of documents, chosen from the buckets' sums of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

BUCKETS = 8192


def water_fill(sizes: dict[str, float], weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens to draw from each source: shares of ``total`` by weight, none above cap x size; what a clamped source
    cannot give goes to the others in proportion, until all fit or all are clamped."""
    limit = {s: caps[s] * sizes.get(s, 0.0) for s in weights}
    take: dict[str, float] = {}
    free = {s for s in weights if weights[s] > 0}
    rest = total
    while free:
        norm = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / norm > limit[s] * (1 + 1e-12)]
        if not over:
            take |= {s: rest * weights[s] / norm for s in free}
            break
        for s in over:
            take[s] = limit[s]
            free.discard(s)
        rest = max(0.0, total - sum(take.values()))
    return {s: take.get(s, 0.0) for s in weights}


def reachable_total(sizes: dict[str, float], weights: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total at which every source that has documents reaches its share within its cap."""
    norm = sum(w for s, w in weights.items() if sizes.get(s, 0) > 0) or 1.0
    return min((caps[s] * sizes[s] * norm / w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0), default=0.0)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", total: float | str = "corpus", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((key, source, tokens, copies), shares per source).

    ``targets`` is (source, target_share, max_repeats), a small dimension table; documents of other or null sources,
    or of null size, are not used.  ``total``: tokens to reach; ``corpus``, the size of the corpus (small
    sources are clamped at their cap, and the rest goes to the others); or ``reachable``, the largest total at which every
    source is exactly at its share, which the scarcest source may keep far below the corpus.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    t = {r[0]: (float(r[1] or 0), float(r[2] or 0)) for r in targets.select(source, "target_share", "max_repeats").where(F.col(source).isNotNull()).collect()}
    d = ws.keep(docs.select(key, source, F.col(size).cast("long").alias("tokens")).where(F.col("tokens").isNotNull() & F.col(source).isNotNull()), "docs")
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BUCKETS)).cast("int")
    sums = d.groupBy(source, bucket.alias("b")).agg(F.sum("tokens").alias("w"))
    rows = [r for r in sums.where(F.col(source).isin(list(t))).collect()]  # at most targets x BUCKETS rows
    per: dict[str, dict[int, int]] = {}
    for r in rows:
        per.setdefault(r[0], {})[r["b"]] = r["w"]
    sizes = {s: float(sum(b.values())) for s, b in per.items()}
    weights, caps = {s: w for s, (w, _) in t.items()}, {s: c for s, (_, c) in t.items()}
    goal = reachable_total(sizes, weights, caps) if total == "reachable" else sum(sizes.values()) if total == "corpus" else float(total)
    take = water_fill(sizes, weights, caps, goal)
    plan, extra = [], []
    for s in t:
        n = sizes.get(s, 0.0)
        whole = int(take[s] / n + 1e-9) if n else 0
        want, run = take[s] - whole * n, 0.0
        for b in sorted(per.get(s, {})) if whole < caps[s] else ():  # buckets in hash order, one that would overshoot is passed over
            w = per[s][b]
            if run + w <= want:
                run += w
                extra.append((s, b))
        plan.append((s, whole, take[s], n, float(goal)))
    p = docs.sparkSession.createDataFrame(plan, f"{source} string, whole int, goal double, available double, total double")
    x = docs.sparkSession.createDataFrame(extra, f"{source} string, b int").withColumn("once", F.lit(1))
    out = d.join(F.broadcast(p.select(source, "whole")), source).withColumn("b", bucket)  # one row per target
    out = out.join(F.broadcast(x), [source, "b"], "left")  # at most targets x BUCKETS rows
    out = out.withColumn("copies", F.col("whole") + F.coalesce("once", F.lit(0))).where("copies > 0").select(key, source, "tokens", "copies")
    out = ws.keep(out, "mixture")
    got = out.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    all_tokens = F.lit(float(out.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0))
    shares = targets.select(source, "target_share", "max_repeats").join(F.broadcast(p), source).join(got, source, "left")
    used = F.coalesce("used_tokens", F.lit(0))
    shares = shares.select(
        source,
        "target_share",
        F.when(all_tokens > 0, F.round(used / all_tokens, 6)).otherwise(0.0).alias("reached_share"),
        used.alias("used_tokens"),
        F.col("available").cast("long").alias("available_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "max_repeats",
        (F.col("goal") >= F.col("available") * F.col("max_repeats") * (1 - 1e-9)).alias("clamped"),
    )
    return out, shares
