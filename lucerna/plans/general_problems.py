"""Queries of the two general problems: p2 (nested records) and p4 (orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten, orphans
from ..operators.skew import heavy_keys, union_all
from ..session import table
from ..workspace import Workspace


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.routed(table(spark, sf, "graph_routing"), Workspace(spark, "variants"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of all variant tables and of their children."""
    return flatten.supertype(_items(spark, sf))


def p2_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each variant table."""
    return _items(spark, sf).groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("record_id").alias("n_records"))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.graph_roots(table(spark, sf, "graph_routing"))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.of_kind(_items(spark, sf), "entity", {"name": ("name", "label", "text"), "type": ("type",)})


def p2_relations(spark: SparkSession, sf: str) -> DataFrame:
    """``source_ref`` and ``target_ref`` hold what the record gave: an entity's id or its name."""
    return flatten.of_kind(_items(spark, sf), "relation", {"relation": ("relation",), "source_ref": ("source",), "target_ref": ("target",), "question_relevance": ("question_relevance",)})


def p2_aspects(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.of_kind(_items(spark, sf), "aspect", {"description": ("description",), "question_relevance": ("question_relevance",)})


def p2_evidence(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return flatten.evidence(items, "relation").unionByName(flatten.evidence(items, "aspect"))


def p2_relation_links(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.relation_links(_roots(spark, sf))


def p2_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _roots(spark, sf).groupBy("shape").agg(F.count(F.lit(1)).alias("n_records"))


def _written(c: str):
    return (F.col(c).isNotNull()) & (F.col(c) != "")


def _references(spark: SparkSession, sf: str, only_orphans: bool) -> DataFrame:
    """Every reference of the two tables with its ``reason`` (null: valid)."""
    arms = table(spark, sf, "evidence_arms").select("arm_row_id", "run_utc", F.explode("evidence_snippet_ids").alias("ref_key")).where(_written("ref_key"))
    snippets = table(spark, sf, "candidate_snippets").select("snippet_id", "loaded_at", "retired_at")
    a = orphans.resolve_in_time(arms, "ref_key", "run_utc", snippets, "snippet_id", "loaded_at", "retired_at", "arm_row_id", ["arm_row_id"])
    a = a.select(F.lit("evidence_arms").alias("src_table"), F.col("arm_row_id").alias("src_id"), F.lit("evidence_snippet_ids").alias("ref_field"), "ref_key", F.col("run_utc").alias("at"), "reason")

    records = table(spark, sf, "reaudit_outputs")
    checks = table(spark, sf, "claim_verifications").select("verification_id", "record_id", "variant", "claim_id", "evidence_ids", "checked_at")
    heavy = heavy_keys(checks, "record_id")
    carry = ["verification_id", "variant", "claim_id", "evidence_ids"]
    v = orphans.resolve_in_time(checks, "record_id", "checked_at", records.select("record_id", "arrived_at", "deleted_at"), "record_id", "arrived_at", "deleted_at", "verification_id", carry)
    # one row for each reference: the claim id and the evidence ids, spread together so that the join above runs once
    each = F.concat(
        F.array(F.struct(F.lit("claim_id").alias("f"), F.col("claim_id").alias("k"))),
        F.transform(F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>")), lambda e: F.struct(F.lit("evidence_ids").alias("f"), e.alias("k"))),
    )
    v = v.select("verification_id", "record_id", "variant", "checked_at", F.col("reason").alias("rec_reason"), F.explode(each).alias("x"))
    # an evidence id has no variant: its key is (record, field, '', id); a claim's is (record, field, variant, id)
    v = v.select(
        "verification_id",
        "record_id",
        "checked_at",
        "rec_reason",
        F.col("x.f").alias("ref_field"),
        F.when(F.col("x.f") == "evidence_ids", F.lit("")).otherwise(F.col("variant")).alias("part"),
        F.col("x.k").alias("ref_key"),
    ).where(_written("ref_key"))
    claims = records.select("record_id", F.lit("claim_id").alias("ref_field"), F.explode("claims").alias("c")).select("record_id", "ref_field", F.col("c.variant").alias("part"), F.col("c.claim_id").alias("ref_key"))
    items = records.select("record_id", F.lit("evidence_ids").alias("ref_field"), F.lit("").alias("part"), F.explode("evidence").alias("c")).select(
        "record_id", "ref_field", "part", F.col("c.evidence_id").alias("ref_key")
    )
    inside = claims.unionByName(items).where(_written("ref_key"))
    # evidence ids have the part '' even where every variant is null
    parts = sorted({False, *(m for (m,) in orphans.null_masks(checks, ["variant"]))})
    masks = [(False, False, m, False) for m in parts] + [(True, False, m, False) for m in (False, True)] * bool(checks.where("record_id is null").limit(1).count())
    keys = ["record_id", "ref_field", "part", "ref_key"]
    v = orphans.composite_match(v, inside, keys, "partial", masks=masks, salt_with="verification_id", heavy=heavy)
    reason = F.coalesce("rec_reason", F.when(~F.col("matched"), "missing"))
    b = v.select(F.lit("claim_verifications").alias("src_table"), F.col("verification_id").alias("src_id"), "ref_field", "ref_key", F.col("checked_at").alias("at"), reason.alias("reason"))
    both = union_all([a, b])
    if only_orphans:
        both = both.where(F.col("reason").isNotNull())
    return both.withColumn("period", F.date_format("at", "yyyy-MM")).drop("at")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf, True).select("src_table", "src_id", "ref_field", "ref_key", "period", "reason").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, sf))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans per table, field and month."""
    r = _references(spark, sf, False).distinct()
    return r.groupBy("src_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("n_references"), F.count("reason").alias("n_orphans"))


_P4_SQL = """
WITH snip AS (SELECT snippet_id k, loaded_at s, coalesce(retired_at, TIMESTAMP '9999-12-31') e FROM candidate_snippets),
rec AS (SELECT record_id k, arrived_at s, coalesce(deleted_at, TIMESTAMP '9999-12-31') e FROM reaudit_outputs),
arm AS (SELECT DISTINCT arm_row_id id, run_utc t, k FROM (SELECT arm_row_id, run_utc, unnest(evidence_snippet_ids) k FROM evidence_arms) WHERE k IS NOT NULL AND k <> ''),
arm_state AS (SELECT a.id, a.t, a.k, bool_or(coalesce(s.s <= a.t AND a.t < s.e, false)) ok, min(s.s) first_s, count(s.k) n
  FROM arm a LEFT JOIN snip s ON s.k = a.k GROUP BY 1, 2, 3),
ver AS (SELECT DISTINCT verification_id id, record_id, variant, claim_id, evidence_ids, checked_at t FROM claim_verifications),
ver_state AS (SELECT v.id, v.record_id, v.t, bool_or(coalesce(r.s <= v.t AND v.t < r.e, false)) ok, min(r.s) first_s, count(r.k) n
  FROM ver v LEFT JOIN rec r ON r.k = v.record_id GROUP BY 1, 2, 3),
refs AS (SELECT id, record_id, t, 'claim_id' f, variant part, claim_id k FROM ver
  UNION ALL SELECT id, record_id, t, 'evidence_ids', '', unnest(evidence_ids) FROM ver),
inside AS (SELECT record_id, 'claim_id' f, c.variant part, c.claim_id k FROM (SELECT record_id, unnest(claims) c FROM reaudit_outputs)
  UNION SELECT record_id, 'evidence_ids', '', c.evidence_id FROM (SELECT record_id, unnest(evidence) c FROM reaudit_outputs)),
all_orphans AS (
SELECT 'evidence_arms' src_table, id src_id, 'evidence_snippet_ids' ref_field, k ref_key, strftime(t, '%Y-%m') period,
  CASE WHEN n = 0 THEN 'missing' WHEN t < first_s THEN 'late' ELSE 'deleted' END reason FROM arm_state WHERE NOT ok
UNION
SELECT 'claim_verifications', r.id, r.f, r.k, strftime(r.t, '%Y-%m'),
  CASE WHEN s.ok OR s.n = 0 THEN 'missing' WHEN r.t < s.first_s THEN 'late' ELSE 'deleted' END
FROM refs r JOIN ver_state s ON s.id = r.id AND s.record_id IS NOT DISTINCT FROM r.record_id AND s.t = r.t
WHERE r.k IS NOT NULL AND r.k <> '' AND (NOT s.ok OR NOT EXISTS (SELECT 1 FROM inside i WHERE i.record_id = r.record_id AND i.f = r.f AND (r.part IS NULL OR i.part = r.part) AND i.k = r.k)))
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_variants": p2_variants,
    "p2_entities": p2_entities,
    "p2_relations": p2_relations,
    "p2_aspects": p2_aspects,
    "p2_evidence": p2_evidence,
    "p2_relation_links": p2_relation_links,
    "p2_shapes": p2_shapes,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_rates": p4_rates,
}

_P2_SQL = """
WITH g AS (SELECT record_id, coalesce(to_json(graph), CASE WHEN json_valid(graph_json) THEN graph_json::JSON END) j FROM graph_routing),
u AS (SELECT record_id, CASE WHEN json_type(j, '$.graph') = 'OBJECT' THEN json_extract(j, '$.graph') ELSE j END j FROM g),
slot AS (SELECT record_id, 'entity' kind, json_extract(j, '$.entities') s FROM u UNION ALL SELECT record_id, 'relation', json_extract(j, '$.relations') FROM u
  UNION ALL SELECT record_id, 'aspect', json_extract(j, '$.answer_aspects') FROM u),
lists AS (SELECT record_id, kind, CASE json_type(s) WHEN 'ARRAY' THEN s::JSON[] ELSE [s] END l FROM slot WHERE s IS NOT NULL AND json_type(s) <> 'NULL'),
item AS (SELECT record_id, kind, unnest(l) i, unnest(range(1, len(l) + 1)) p FROM lists),
good AS (SELECT * FROM item WHERE i IS NOT NULL AND json_type(i) <> 'NULL'),
ev AS (SELECT record_id, kind, p, CASE json_type(i, '$.evidence_snippet_ids') WHEN 'ARRAY' THEN json_extract(i, '$.evidence_snippet_ids')::JSON[] ELSE [json_extract(i, '$.evidence_snippet_ids')] END l
  FROM good WHERE kind <> 'entity' AND json_type(i, '$.evidence_snippet_ids') IS NOT NULL),
evi AS (SELECT record_id, kind, p, unnest(l) e, unnest(range(1, len(l) + 1)) q FROM ev),
own AS (SELECT record_id, kind, p::INT item_pos, i, coalesce(CASE kind WHEN 'entity' THEN coalesce(i->>'$.entity_id', i->>'$.id') WHEN 'relation' THEN i->>'$.edge_id' ELSE i->>'$.aspect_id' END, '') item_key FROM good),
st AS (SELECT *, json_type(i) t, list_transform(CASE kind WHEN 'entity' THEN ['entity_id', 'id', 'name', 'label', 'type'] WHEN 'relation' THEN ['edge_id', 'source', 'relation', 'target', 'question_relevance'] ELSE ['aspect_id', 'description', 'question_relevance'] END,
  lambda f: json_type(i, '$.' || f)) fs, json_type(i, '$.evidence_snippet_ids') et FROM own),
var AS (SELECT *, CASE WHEN t = 'VARCHAR' THEN 'bare' WHEN t <> 'OBJECT' OR list_contains(fs, 'OBJECT') OR list_contains(fs, 'ARRAY') THEN 'other'
  WHEN kind = 'entity' THEN CASE WHEN m AND o THEN 'mixed' WHEN m THEN 'standard' WHEN o THEN 'alias' ELSE 'nameless' END
  WHEN et = 'ARRAY' THEN CASE WHEN len(list_filter(json_extract(i, '$.evidence_snippet_ids')::JSON[], lambda x: coalesce(json_type(x) IN ('OBJECT', 'ARRAY'), false))) > 0 THEN 'cited_nested' ELSE 'cited' END
  WHEN coalesce(et, 'NULL') = 'NULL' THEN 'uncited' ELSE 'cited_one' END variant
  FROM (SELECT *, coalesce(fs[1], 'NULL') <> 'NULL' OR coalesce(fs[3], 'NULL') <> 'NULL' m, coalesce(fs[2], 'NULL') <> 'NULL' OR coalesce(fs[4], 'NULL') <> 'NULL' o FROM st))
"""
_P2_EVIDENCE = "SELECT record_id, kind, p::INT item_pos, q::INT sub_pos, e->>'$' k FROM evi WHERE e IS NOT NULL AND json_type(e) <> 'NULL'"

ORACLE = {
    "p2_found": _P2_SQL + f"SELECT record_id, kind AS child, item_pos, 0 AS sub_pos, item_key FROM own UNION SELECT record_id, kind || '_evidence', item_pos, sub_pos, k FROM ({_P2_EVIDENCE})",
    "p2_variants": _P2_SQL + "SELECT kind, variant, count(*) AS n_items, count(DISTINCT record_id) AS n_records FROM var GROUP BY 1, 2",
    "p2_entities": _P2_SQL + "SELECT record_id, item_pos, item_key, CASE WHEN variant = 'bare' THEN i->>'$' WHEN variant <> 'other' THEN coalesce(i->>'$.name', i->>'$.label') END AS name, CASE WHEN variant NOT IN ('bare', 'other') THEN i->>'$.type' END AS type, variant FROM var WHERE kind = 'entity'",
    "p2_relations": _P2_SQL + "SELECT record_id, item_pos, item_key, CASE WHEN ok THEN i->>'$.relation' END AS relation, CASE WHEN ok THEN i->>'$.source' END AS source_ref, CASE WHEN ok THEN i->>'$.target' END AS target_ref, CASE WHEN ok THEN i->>'$.question_relevance' END AS question_relevance, variant FROM (SELECT *, variant NOT IN ('bare', 'other') ok FROM var WHERE kind = 'relation')",
    "p2_aspects": _P2_SQL + "SELECT record_id, item_pos, item_key, CASE WHEN ok THEN i->>'$.description' END AS description, CASE WHEN ok THEN i->>'$.question_relevance' END AS question_relevance, variant FROM (SELECT *, variant NOT IN ('bare', 'other') ok FROM var WHERE kind = 'aspect')",
    "p2_evidence": _P2_SQL + f"SELECT record_id, kind AS parent, item_pos, sub_pos, k AS snippet_id FROM ({_P2_EVIDENCE})",
    # the clean graphs of the evaluation queries: every non-null snippet id of a graph is among its candidates
    "edge_texts": _P2_SQL
    + """, cited AS (SELECT record_id, kind, p::INT item_pos, count(*) FILTER (WHERE e IS NOT NULL AND json_type(e) <> 'NULL') n FROM evi GROUP BY 1, 2, 3),
en AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY item_pos) r FROM (SELECT record_id, item_pos, coalesce(i->>'$.entity_id', i->>'$.id') id, coalesce(i->>'$.name', i->>'$.label') nm FROM own WHERE kind = 'entity') WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(nm, '')) <> ''),
known AS (SELECT record_id, list(id) || list(nm) k FROM en WHERE r <= 12 GROUP BY 1),
rel AS (SELECT o.record_id, concat_ws(' ', o.i->>'$.edge_id', o.i->>'$.source', o.i->>'$.relation', o.i->>'$.target') t, row_number() OVER (PARTITION BY o.record_id ORDER BY o.item_pos) r
  FROM own o JOIN known k ON k.record_id = o.record_id JOIN cited c ON c.record_id = o.record_id AND c.kind = o.kind AND c.item_pos = o.item_pos
  WHERE o.kind = 'relation' AND c.n > 0 AND list_contains(k.k, o.i->>'$.source') AND list_contains(k.k, o.i->>'$.target'))
SELECT g.record_id, md5(coalesce(string_agg(t, chr(10) ORDER BY r) FILTER (WHERE r <= 16), 'NO_SUPPORTED_GRAPH_EDGE')) AS edges_md5 FROM graph_routing g LEFT JOIN rel ON rel.record_id = g.record_id GROUP BY 1""",
    "graph_normalised": _P2_SQL
    + """, cited AS (SELECT record_id, kind, p::INT item_pos, count(*) FILTER (WHERE e IS NOT NULL AND json_type(e) <> 'NULL') n FROM evi GROUP BY 1, 2, 3),
en AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY item_pos) r FROM (SELECT record_id, item_pos, coalesce(i->>'$.entity_id', i->>'$.id') id, coalesce(i->>'$.name', i->>'$.label') nm FROM own WHERE kind = 'entity') WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(nm, '')) <> ''),
known AS (SELECT record_id, list(id) || list(nm) k FROM en WHERE r <= 12 GROUP BY 1),
rel AS (SELECT o.record_id, count(*) n FROM own o JOIN known k ON k.record_id = o.record_id JOIN cited c ON c.record_id = o.record_id AND c.kind = o.kind AND c.item_pos = o.item_pos
  WHERE o.kind = 'relation' AND c.n > 0 AND list_contains(k.k, o.i->>'$.source') AND list_contains(k.k, o.i->>'$.target') GROUP BY 1),
asp AS (SELECT o.record_id, count(*) n FROM own o JOIN cited c ON c.record_id = o.record_id AND c.kind = o.kind AND c.item_pos = o.item_pos WHERE o.kind = 'aspect' AND c.n > 0 AND trim(coalesce(o.i->>'$.description', '')) <> '' GROUP BY 1),
ne AS (SELECT record_id, count(*) n FROM en GROUP BY 1)
SELECT g.record_id, least(12, coalesce(ne.n, 0))::INT AS n_entities, least(16, coalesce(rel.n, 0))::INT AS n_relations, least(12, coalesce(asp.n, 0))::INT AS n_aspects,
  (greatest(coalesce(ne.n, 0) - 12, 0) + greatest(coalesce(rel.n, 0) - 16, 0) + greatest(coalesce(asp.n, 0) - 12, 0))::INT AS n_over_caps
FROM graph_routing g LEFT JOIN ne ON ne.record_id = g.record_id LEFT JOIN rel ON rel.record_id = g.record_id LEFT JOIN asp ON asp.record_id = g.record_id""",
    "p4_found": _P4_SQL + "SELECT * FROM all_orphans",
    "p2_relation_links": _P2_SQL
    + """, ent AS (SELECT record_id, list_transform(l, lambda e: coalesce(e->>'$.entity_id', e->>'$.id', '')) ids, list_transform(l, lambda e: coalesce(e->>'$.name', e->>'$.label', '')) names FROM lists WHERE kind = 'entity')
SELECT v.record_id, item_pos, item_key AS edge_key, CASE WHEN coalesce(src, '') <> '' THEN coalesce(nullif(list_position(ids, src), 0), nullif(list_position(names, src), 0)) END::INT AS source_pos,
  CASE WHEN coalesce(dst, '') <> '' THEN coalesce(nullif(list_position(ids, dst), 0), nullif(list_position(names, dst), 0)) END::INT AS target_pos
FROM (SELECT *, i->>'$.source' src, i->>'$.target' dst FROM own WHERE kind = 'relation') v LEFT JOIN ent ON ent.record_id = v.record_id""",
    "p2_shapes": _P2_SQL
    + """, s AS (SELECT record_id, list_transform(['$', '$.entities', '$.relations', '$.answer_aspects'], lambda f: CASE coalesce(json_type(j, f), 'NONE') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN CASE f WHEN '$' THEN 'null' ELSE 'absent' END WHEN 'NONE' THEN 'absent' ELSE 'scalar' END) t FROM u)
SELECT t[1] || '(' || t[2] || ',' || t[3] || ',' || t[4] || ')' AS shape, count(*) AS n_records FROM s GROUP BY 1""",
    "p4_rates": _P4_SQL + """, every AS (SELECT DISTINCT 'evidence_arms' src_table, id, 'evidence_snippet_ids' ref_field, k, strftime(t, '%Y-%m') period FROM arm UNION SELECT 'claim_verifications', id, f, k, strftime(t, '%Y-%m') FROM refs WHERE k IS NOT NULL AND k <> '')
SELECT e.src_table, e.ref_field, e.period, count(*) AS n_references, count(o.reason) AS n_orphans FROM every e LEFT JOIN all_orphans o ON o.src_table = e.src_table AND o.src_id = e.id AND o.ref_field = e.ref_field AND o.ref_key = e.k GROUP BY 1, 2, 3""",
    "p4_report": _P4_SQL + "SELECT src_table, ref_field, period, reason, count(*)::BIGINT AS n_orphans FROM all_orphans GROUP BY ALL",
}
