"""Retrieval queries: BM25, dense, fusion, quality and uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bucket
from ..operators import dense, fusion, lexical, metrics
from ..session import table
from ..workspace import Workspace

ROUTE_COST = {"bm25": 1, "stored": 2, "fused": 3}


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    """The snippet bank with one row per key."""
    return table(spark, sf, "candidate_snippets").where("snippet_id is not null").groupBy("snippet_id").agg(F.min("text").alias("text"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every record whose id is divisible by 50."""
    return table(spark, sf, "graph_routing").where("record_id % 50 = 0")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_topk(_questions(spark, sf), _bank(spark, sf), "record_id", "question", "snippet_id", "text", 20)


def bm25_term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Document and collection frequency of every term of the bank."""
    p = lexical.postings(_bank(spark, sf), "snippet_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return dense.dense_topk(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20)


def dense_label_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the same label count as relevant."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    r = dense_topk(spark, sf).join(e, "vec_id").join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q")
    first = r.groupBy(F.lit("dense").alias("method"), "q", F.col("ql").cast("string").alias("label")).agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first_rank"))
    return metrics.retrieval_summary(first.drop("label"), first.select("q", "label"), ["label"])


def _rankings(spark: SparkSession, sf: str) -> DataFrame:
    """(method, q, item, rank, score): BM25, the stored list, and their fusion; written once for all that compare them."""
    a = bm25_topk(spark, sf).select(F.lit("bm25").alias("method"), F.col("record_id").alias("q"), F.col("snippet_id").alias("item"), "rank", "score")
    s = _questions(spark, sf).select(F.col("record_id").alias("q"), F.posexplode("hybrid_top5").alias("p", "item")).where("item is not null")
    s = s.groupBy("q", "item").agg((F.min("p") + 1).alias("rank")).select(F.lit("stored").alias("method"), "q", "item", "rank", (1.0 / F.col("rank")).alias("score"))
    ws = Workspace(spark, "rankings")
    both = ws.keep(a.unionByName(s), "two")
    fused = fusion.reciprocal_rank_fusion(both).select(F.lit("fused").alias("method"), "q", "item", "rank", "score")
    return both.unionByName(ws.keep(fused, "fused"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant: the snippets of the selection trace."""
    return _questions(spark, sf).select(F.col("record_id").alias("q"), F.explode("selection_trace.snippet_id").alias("item")).where("item is not null").distinct()


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rankings(spark, sf).where("method = 'fused'").select("q", "item", "rank", "score")


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_relevant(_rankings(spark, sf), _gold(spark, sf))


def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and MRR per method, overall, by question type and by role: one pass of grouping sets."""
    a = _questions(spark, sf).select(F.col("record_id").alias("q"), "question_type", "structural_role")
    return metrics.retrieval_summary(_first(spark, sf), a, ["question_type", "structural_role"])


def method_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.overlap_at(_rankings(spark, sf), "bm25", "stored", (5, 10))


def rank_shift_flags(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_shifts(_first(spark, sf), "bm25", "fused")


def retrieval_rescue(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rescued(_first(spark, sf), "bm25", 5)


def cheapest_best_method(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.best_method(_first(spark, sf), ROUTE_COST)


def uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """Composite of margin places and disagreement, with its label."""
    r = _rankings(spark, sf)
    m = fusion.margins(r.where("method <> 'fused'")).groupBy("q").agg(F.max(F.when(F.col("method") == "bm25", F.col("margin"))).alias("bm25_margin"), F.max(F.when(F.col("method") == "stored", F.col("margin"))).alias("stored_margin"))
    m = m.select("q", F.coalesce("bm25_margin", F.lit(0.0)).alias("bm25_margin"), F.coalesce("stored_margin", F.lit(0.0)).alias("stored_margin"))
    m = fusion.place_share(fusion.place_share(m, "bm25_margin", "q", "pr_bm25"), "stored_margin", "q", "pr_stored")
    o = fusion.overlap_at(r, "bm25", "stored", (10,))
    u = m.join(o, "q").withColumn("score", F.round(fusion.weighted_sum([(0.30, 1 - F.col("pr_stored")), (0.20, 1 - F.col("pr_bm25")), (0.25, 1 - F.col("overlap_at_10")), (0.25, 1 - F.col("same_top1"))]), 8))
    return u.select("q", "score", bucket(F.col("score"), [0.40, 0.65], ["low", "medium", "high"]).alias("label"))


_BM25 = r"""
WITH bank AS (SELECT snippet_id, min(text) AS text FROM candidate_snippets WHERE snippet_id IS NOT NULL GROUP BY 1),
tf AS (SELECT snippet_id doc, term, count(*) tf FROM (SELECT snippet_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM bank) GROUP BY 1, 2),
dl AS (SELECT doc, sum(tf)::DOUBLE dl FROM tf GROUP BY 1), st AS (SELECT count(*)::DOUBLE n, avg(dl) a FROM dl), df AS (SELECT term, count(*)::DOUBLE df FROM tf GROUP BY 1),
qt AS (SELECT record_id q, term, count(*) qtf FROM (SELECT record_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) term FROM graph_routing WHERE record_id % 50 = 0) GROUP BY 1, 2),
sc AS (SELECT q, tf.doc, round(sum(qtf * ln(1 + (n - df + .5) / (df + .5)) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * dl / a))), 8) score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc = tf.doc CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT q, doc item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) rank FROM sc) WHERE rank <= 20),
"""
_RANKS = _BM25 + r"""
stored AS (SELECT q, item, min(p) rank FROM (SELECT record_id q, unnest(hybrid_top5) item, unnest(range(1, len(hybrid_top5) + 1)) p FROM graph_routing WHERE record_id % 50 = 0) WHERE item IS NOT NULL GROUP BY 1, 2),
two AS (SELECT 'bm25' AS method, q, item, rank, score FROM bm UNION ALL SELECT 'stored', q, item, rank, 1.0::DOUBLE / rank FROM stored),
fu AS (SELECT q, item, round(sum(1.0::DOUBLE / (60 + rank)), 8) score FROM two GROUP BY 1, 2),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) rank FROM fu) WHERE rank <= 100),
ranks AS (SELECT * FROM two UNION ALL SELECT 'fused', q, item, rank, score FROM fr),
gold AS (SELECT DISTINCT q, item FROM (SELECT record_id q, unnest(list_transform(selection_trace, lambda x: x.snippet_id)) item FROM graph_routing WHERE record_id % 50 = 0) WHERE item IS NOT NULL),
first AS (SELECT method, r.q, min(rank) FILTER (WHERE g.item IS NOT NULL) fr FROM ranks r LEFT JOIN gold g ON g.q = r.q AND g.item = r.item WHERE rank <= 20 GROUP BY 1, 2),
ov AS (SELECT q, item, max(rank) w, count(DISTINCT method) n FROM two WHERE rank <= 20 GROUP BY 1, 2),
"""
_END = "fin AS (SELECT 1) "
_DENSE = """
WITH q AS (SELECT vec_id q, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
s AS (SELECT q, vec_id, round(list_dot_product(q.e, c.e), 8) score FROM q JOIN c ON c.vec_id <> q.q),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20)
"""

QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_term_statistics, dense_topk, dense_label_quality, rrf_fusion, retrieval_quality, method_overlap, rank_shift_flags, retrieval_rescue, cheapest_best_method, uncertainty,
)}

_HITS = "round(avg(CASE WHEN fr <= 1 THEN 1 ELSE 0 END), 6) hit_at_1, round(avg(CASE WHEN fr <= 5 THEN 1 ELSE 0 END), 6) hit_at_5, round(avg(CASE WHEN fr <= 10 THEN 1 ELSE 0 END), 6) hit_at_10, round(avg(CASE WHEN fr <= 20 THEN 1 ELSE 0 END), 6) hit_at_20, round(avg(coalesce(1.0::DOUBLE / fr, 0)), 6) mrr, count(*) n"

ORACLE = {
    "bm25_topk": _BM25 + _END + "SELECT q AS record_id, rank, item AS snippet_id, score FROM bm",
    "bm25_term_statistics": _BM25 + _END + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1",
    "dense_topk": _DENSE + "SELECT q, rank, vec_id, score FROM r",
    "dense_label_quality": _DENSE + f""", f AS (SELECT 'dense' AS method, r.q, b.label::VARCHAR AS label, min(rank) FILTER (WHERE a.label = b.label) fr FROM r JOIN embeddings a ON a.vec_id = r.vec_id JOIN embeddings b ON b.vec_id = r.q GROUP BY 1, 2, 3)
SELECT method, coalesce(label, 'all') AS label, {_HITS} FROM f GROUP BY GROUPING SETS ((method), (method, label))""",
    "rrf_fusion": _RANKS + _END + "SELECT q, item, rank, score FROM fr",
    "retrieval_quality": _RANKS
    + f"""att AS (SELECT record_id q, question_type, structural_role FROM graph_routing), t AS (SELECT method, fr, coalesce(question_type, 'none') question_type, coalesce(structural_role, 'none') structural_role FROM first LEFT JOIN att USING (q))
SELECT method, coalesce(question_type, 'all') AS question_type, coalesce(structural_role, 'all') AS structural_role, {_HITS} FROM t GROUP BY GROUPING SETS ((method), (method, question_type), (method, structural_role))""",
    "method_overlap": _RANKS
    + _END
    + "SELECT q, count(*) FILTER (WHERE n = 2 AND w <= 5) / 5.0::DOUBLE AS overlap_at_5, count(*) FILTER (WHERE n = 2 AND w <= 10) / 10.0::DOUBLE AS overlap_at_10, max(CASE WHEN n = 2 AND w = 1 THEN 1 ELSE 0 END) AS same_top1 FROM (SELECT q, item, max(rank) w, count(DISTINCT method) n FROM two WHERE rank <= 10 GROUP BY 1, 2) GROUP BY q",
    "rank_shift_flags": _RANKS
    + "x AS (SELECT q, coalesce(max(fr) FILTER (WHERE method = 'bm25'), 999) b, coalesce(max(fr) FILTER (WHERE method = 'fused'), 999) o FROM first GROUP BY q) SELECT q, (b - o >= 3)::INT AS improves, (o - b >= 3)::INT AS hurts FROM x",
    "retrieval_rescue": _RANKS
    + "miss AS (SELECT q FROM first GROUP BY q HAVING NOT bool_or(method = 'bm25' AND coalesce(fr <= 5, false)) AND bool_or(method = 'bm25')) SELECT method, count(DISTINCT q) AS n_missed, count(*) FILTER (WHERE fr <= 5) AS n_rescued FROM first JOIN miss USING (q) WHERE method <> 'bm25' GROUP BY 1",
    "cheapest_best_method": _RANKS
    + "x AS (SELECT q, method, row_number() OVER (PARTITION BY q ORDER BY coalesce(fr, 999), CASE method WHEN 'bm25' THEN 1 WHEN 'stored' THEN 2 ELSE 3 END) o FROM first) SELECT q, method FROM x WHERE o = 1",
    "uncertainty": _RANKS
    + """m AS (SELECT method, q, coalesce(round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 8), 0) margin FROM two WHERE rank <= 2 GROUP BY 1, 2),
w AS (SELECT q, coalesce(max(margin) FILTER (WHERE method = 'bm25'), 0) mb, coalesce(max(margin) FILTER (WHERE method = 'stored'), 0) ms FROM m GROUP BY q),
p AS (SELECT q, CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY mb, q) - 1) / (count(*) OVER () - 1)::DOUBLE ELSE 0 END pb, CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY ms, q) - 1) / (count(*) OVER () - 1)::DOUBLE ELSE 0 END ps FROM w),
o AS (SELECT q, count(*) FILTER (WHERE n = 2 AND w <= 10) / 10.0::DOUBLE o10, max(CASE WHEN n = 2 AND w = 1 THEN 1 ELSE 0 END) s1 FROM (SELECT q, item, max(rank) w, count(DISTINCT method) n FROM two WHERE rank <= 10 GROUP BY 1, 2) GROUP BY q),
u AS (SELECT q, round(.30::DOUBLE * (1 - ps) + .20::DOUBLE * (1 - pb) + .25::DOUBLE * (1 - o10) + .25::DOUBLE * (1 - s1), 8) score FROM p JOIN o USING (q))
SELECT q, score, CASE WHEN score < .40 THEN 'low' WHEN score < .65 THEN 'medium' ELSE 'high' END AS label FROM u""",
}
