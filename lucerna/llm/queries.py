"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import table
from ..workspace import Workspace
from . import confusables, formatting_duplicates, grouped_splits, mixing, packing, pair_defects, split_overlap, tokens, truncation

PILOT = 1 << 60  # pilots follow all body records in the order of nodes


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pair_defects.defects(table(spark, sf, "paired_answers")).select("pair_id", "defect")


def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Defective pairs per kind and per step that showed them."""
    return pair_defects.defects(table(spark, sf, "paired_answers")).groupBy("defect", "evidence").agg(F.count(F.lit(1)).alias("n_pairs"))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per question type, with the number of released pairs."""
    p = table(spark, sf, "paired_answers")
    r = p.where(pair_defects.released(F.col("bge_final_disposition"))).select("pair_id", "question_type")
    return r.join(p1_found(spark, sf), "pair_id", "left").groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n_released"), *[F.count_if(F.col("defect") == d).alias(f"n_{d}") for d in pair_defects.DEFECTS]
    )


def _body_columns():
    return {"normalised_body": formatting_duplicates.body_token, "ids": formatting_duplicates.set_tokens, "extra": formatting_duplicates.json_tokens}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    c = formatting_duplicates.collapse(table(spark, sf, "body_records"), "record_id", _body_columns())
    return c.where("record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct record with the number of its copies."""
    c = formatting_duplicates.collapse(table(spark, sf, "body_records"), "record_id", _body_columns())
    return c.where("record_id = keep_id").select("record_id", "copies")


def _p3_batch(b: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ties).  Bodies without a letter or digit, null and empty ids tie nothing."""
    body = formatting_duplicates.letters_and_digits(F.col("normalised_body"))
    node = F.col("record_id").alias("node")
    pnode = (F.col("pilot_id") + PILOT).alias("node")
    by_id = b.select(node, F.explode("ids").alias("i")).where("i is not null and i <> ''").select("node", grouped_splits.key_hash(F.lit("id"), "i").alias("key"))
    by_body = b.where(body != "").select(node, grouped_splits.key_hash(F.lit("body"), body).alias("key"))
    by_pilot = p.where("question_id is not null and question_id <> ''").select(pnode, grouped_splits.key_hash(F.lit("id"), "question_id").alias("key"))
    return b.select(node).unionByName(p.select(pnode)), by_id.unionByName(by_body).unionByName(by_pilot)


def _member(df: DataFrame) -> DataFrame:
    pilot = F.col("node") >= PILOT
    return df.withColumn("member_table", F.when(pilot, "graph_claim_pilot_manifest").otherwise("body_records")).withColumn("member_id", F.when(pilot, F.col("node") - PILOT).otherwise(F.col("node")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    ws = Workspace(spark, "groups")
    nodes, ties = _p3_batch(table(spark, sf, "body_records"), table(spark, sf, "graph_claim_pilot_manifest"))
    members, _, _ = grouped_splits.attach(grouped_splits.Components.empty(spark), nodes, ties, ws, fresh=True)
    sizes = ws.keep(members.where(F.col("comp") < PILOT).groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    heavy = grouped_splits._heavy(sizes, "comp")
    m = salted_join(members, sizes.where("n > 1").select("comp"), ["comp"], "inner", heavy, F.col("node"))
    return _member(m).select(F.col("comp").alias("group_id"), "member_table", "member_id")


def _targets(spark: SparkSession, sf: str) -> dict[str, float]:
    return {r["split"]: float(r["target_share"]) for r in table(spark, sf, "split_targets").collect()}


def p3_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its component and split."""
    ws = Workspace(spark, "splits")
    nodes, ties = _p3_batch(table(spark, sf, "body_records"), table(spark, sf, "graph_claim_pilot_manifest"))
    _, placed = grouped_splits.advance(grouped_splits.Components.empty(spark), nodes, ties, _targets(spark, sf), ws)
    return _member(placed).select("member_table", "member_id", F.col("comp").alias("group_id"), "split")


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    a = p3_assignment(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("group_id").alias("n_groups"))
    total = F.sum("n_records").over(grouped_splits_all())
    t = table(spark, sf, "split_targets")
    return a.withColumn("share", F.round(F.col("n_records") / total, 6)).join(t, "split", "full").select("split", "target_share", "share", "n_records", "n_groups")


def grouped_splits_all():
    """All rows of a table with one row per split."""
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(1))


def _two_batches(spark: SparkSession, sf: str) -> tuple[grouped_splits.Components, DataFrame, DataFrame]:
    """Two batches: records logged before the middle of the year, then all others."""
    b, p = table(spark, sf, "body_records"), table(spark, sf, "graph_claim_pilot_manifest")
    half = F.lit("2025-07-01").cast("timestamp_ntz")
    late_b, late_p = F.coalesce(F.col("logged_at") >= half, F.lit(True)), F.coalesce(F.col("selected_at") >= half, F.lit(True))
    t = _targets(spark, sf)
    state, one = grouped_splits.advance(grouped_splits.Components.empty(spark), *_p3_batch(b.where(~late_b), p.where(~late_p)), t, Workspace(spark, "splits-a"))
    state, two = grouped_splits.advance(state, *_p3_batch(b.where(late_b), p.where(late_p)), t, Workspace(spark, "splits-b"))
    return state, one, two


def p3_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Records per split, quarantined ones included, of each of two batches."""
    _, one, two = _two_batches(spark, sf)
    both = one.withColumn("batch", F.lit(1)).unionByName(two.withColumn("batch", F.lit(2)))
    return both.groupBy("batch", "split").agg(F.count(F.lit(1)).alias("n_records"))


def p3_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the first batch whose group the second one tied to a group of another split."""
    state, _, _ = _two_batches(spark, sf)
    return _member(grouped_splits.conflicts(state)).select("member_table", "member_id", F.col("comp").alias("group_id"), "split")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A whole reply names the record's claims up to the last one."""
    ids = F.filter(F.transform("claims", lambda c: c["claim_id"]), lambda i: i.isNotNull())
    return table(spark, sf, "reaudit_outputs").select("record_id", "raw_response", "model", ids.alias("labels"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_replies(spark, sf), "record_id", "raw_response", "model", expected="labels").where("truncated").select("record_id")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Truncation per model, and how many at a hidden limit."""
    t = truncation.truncated(_replies(spark, sf), "record_id", "raw_response", "model", expected="labels")
    return t.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_replies"), F.count_if("truncated").alias("n_truncated"), F.count("limit_measure").alias("n_at_limit"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate")
    )


def p5_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The hidden limits per model, under the measure that explains most cut replies, with how many it explains."""
    t = truncation.truncated(_replies(spark, sf), "record_id", "raw_response", "model", expected="labels")
    return t.where("limit_measure is not null").groupBy("model", "limit_measure", "limit_size").agg(F.count(F.lit(1)).alias("n_cut"))


def _evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b, p = table(spark, sf, "body_records"), table(spark, sf, "graph_claim_pilot_manifest")
    text = F.col("normalised_body").alias("text")
    ev = b.where(F.col("split").isin("dev", "test")).select(F.lit("body_records").alias("tab"), F.col("record_id").alias("id"), text)
    ev = ev.unionByName(p.select(F.lit("graph_claim_pilot_manifest").alias("tab"), F.col("pilot_id").alias("id"), F.col("question").alias("text")))
    return ev, b.where("split = 'train'").select(F.col("record_id").alias("id"), text)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    p = split_overlap.overlap_pairs(*_evaluation(spark, sf))
    return p.select(F.col("tab").alias("eval_table"), F.col("id").alias("eval_id"), F.col("train_id").alias("train_record_id"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping evaluation records per split and source (pilots: split 'pilot', no source)."""
    o = split_overlap.overlapping_records(*_evaluation(spark, sf))
    b = table(spark, sf, "body_records").where(F.col("split").isin("dev", "test")).select(F.lit("body_records").alias("tab"), F.col("record_id").alias("id"), "split", "source")
    p = table(spark, sf, "graph_claim_pilot_manifest").select(F.lit("graph_claim_pilot_manifest").alias("tab"), F.col("pilot_id").alias("id"), F.lit("pilot").alias("split"), F.lit(None).cast("string").alias("source"))
    return b.unionByName(p).join(o, ["tab", "id"], "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("n_classes").alias("n_overlapping"), F.count_if(F.coalesce("exact", F.lit(False))).alias("n_exact")
    )


def _sized(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return tokens.sized(table(spark, sf, "documents"), "doc_id", "text", list(keep))


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(_sized(spark, sf), table(spark, sf, "container_sizes"))


def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.summary(p8_windows(spark, sf), table(spark, sf, "container_sizes"))


def _mixed(spark: SparkSession, sf: str, total: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, sf, "source"), table(spark, sf, "mixture_targets"), total=total)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture of the size of the corpus: sources too small for their share are clamped at their cap, the others take the rest."""
    return _mixed(spark, sf, "corpus")[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by ``p9_mixture``, tokens used and available, and which sources are clamped."""
    return _mixed(spark, sf, "corpus")[1]


def p9_exact_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mixture in which every source reaches its share within its cap; the scarcest source sets its size."""
    return _mixed(spark, sf, "reachable")[0]


def p9_exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf, "reachable")[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.look_alike_pairs(table(spark, sf, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that read like another but differ in characters, with their class."""
    return confusables.look_alike_classes(table(spark, sf, "documents"))


def p10_texts(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.consistent_form(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_evidence, p1_rates, p3_found, p3_assignment, p3_shares, p3_incremental, p3_conflicts, p5_found, p5_rates, p5_limits,
    p6_found, p6_records, p7_found, p7_report, p8_windows, p8_summary, p9_mixture, p9_shares, p9_exact_mixture, p9_exact_shares, p10_found, p10_classes, p10_texts,
)}

_P6 = r"""
WITH c AS (SELECT record_id, coalesce('=' || regexp_replace(lower(normalised_body), '[^\p{L}\p{N}]', '', 'g'), 'null') b,
  list_sort(list_distinct(coalesce(ids, []::VARCHAR[]))) i,
  list_sort(list_transform(json_keys(extra), lambda k: k || ':' || json_extract(extra, '$."' || k || '"')::VARCHAR)) e FROM body_records),
s AS (SELECT b, i, e, min(record_id) keep_id, count(*) copies FROM c GROUP BY ALL)
"""

_P3 = r"""
WITH RECURSIVE tie AS (SELECT record_id n, 'i' || unnest(ids) k FROM body_records UNION SELECT record_id, 'b' || regexp_replace(lower(normalised_body), '[^\p{L}\p{N}]', '', 'g') FROM body_records
  UNION SELECT pilot_id + 1152921504606846976, 'i' || question_id FROM graph_claim_pilot_manifest),
t AS (SELECT DISTINCT n, k FROM tie WHERE k IS NOT NULL AND length(k) > 1), h AS (SELECT k, min(n) m FROM t GROUP BY 1),
e AS (SELECT DISTINCT t.n u, h.m v FROM t JOIN h USING (k) WHERE t.n <> h.m), adj AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u a, v b FROM adj UNION SELECT r.a, adj.v FROM r JOIN adj ON adj.u = r.b),
c AS (SELECT a n, least(a, min(b)) comp FROM r GROUP BY a),
keep AS (SELECT comp FROM c GROUP BY 1 HAVING count(*) > 1 AND min(n) < 1152921504606846976)
SELECT comp AS group_id, CASE WHEN n < 1152921504606846976 THEN 'body_records' ELSE 'graph_claim_pilot_manifest' END AS member_table, CASE WHEN n < 1152921504606846976 THEN n ELSE n - 1152921504606846976 END AS member_id
FROM c JOIN keep USING (comp)
"""

_P7 = r"""
WITH RECURSIVE ev AS (SELECT 'body_records' tab, record_id id, regexp_extract_all(lower(normalised_body), '[\p{L}\p{N}]+') w FROM body_records WHERE split IN ('dev', 'test') AND normalised_body IS NOT NULL
  UNION ALL SELECT 'graph_claim_pilot_manifest', pilot_id, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') FROM graph_claim_pilot_manifest WHERE question IS NOT NULL),
tr AS (SELECT record_id id, regexp_extract_all(lower(normalised_body), '[\p{L}\p{N}]+') w FROM body_records WHERE split = 'train' AND normalised_body IS NOT NULL),
a AS (SELECT w, len(w) n, row_number() OVER () k FROM (SELECT DISTINCT w FROM ev)), b AS (SELECT w, len(w) n, row_number() OVER () k FROM (SELECT DISTINCT w FROM tr)),
cand AS (SELECT a.k ka, b.k kb, a.w wa, b.w wb FROM a JOIN b ON abs(a.n - b.n) <= 2
  WHERE len(list_filter(list_distinct(a.w), lambda x: NOT list_contains(b.w, x))) <= 2 AND len(list_filter(list_distinct(b.w), lambda x: NOT list_contains(a.w, x))) <= 2),
d AS (SELECT ka, kb, wa, wb, 0 i, range(0, len(wb) + 1) r FROM cand
  UNION ALL SELECT ka, kb, wa, wb, i + 1, list_transform(range(0, len(wb) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(r[k + 1] + 1, r[k] + (wb[k] <> wa[i + 1])::INT) - k END))) FROM d WHERE i < len(wa)),
near AS (SELECT wa, wb FROM d WHERE i = len(wa) AND r[len(wb) + 1] <= 2)
"""

def _consistent_sql(c: str) -> str:
    """The consistent form as SQL, which cannot decompose: letters with accents are looked up composed."""
    import unicodedata

    composed = {chr(k): unicodedata.normalize("NFC", confusables.skeleton_of(chr(k))) for k in range(128, 0x3000)}
    text = lambda s: "'" + s.replace("'", "''") + "'"
    one = {chr(k): v for k, v in confusables.prototypes().items() if len(v) == 1} | {k: v for k, v in composed.items() if len(v) == 1 and v != k}
    gone = "".join(chr(k) for k, v in confusables.prototypes().items() if not v)
    out = f"nfc_normalize({c})"
    for k, v in confusables.LIGATURES.items():
        out = f"replace({out}, {text(k)}, {text(v)})"
    return f"nfc_normalize(replace(translate({out}, {text(''.join(one) + gone)}, {text(''.join(one.values()))}), chr(13) || chr(10), chr(10)))"


_P10 = f"WITH s AS (SELECT doc_id, text, {_consistent_sql('text')} s FROM documents WHERE text IS NOT NULL) "

ORACLE = {
    "p10_found": _P10 + "SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM s a JOIN s b ON a.s = b.s AND a.text < b.text",
    "p10_classes": _P10 + "SELECT doc_id, c AS class_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) c, min(text) OVER (PARTITION BY s) a, max(text) OVER (PARTITION BY s) b FROM s) WHERE a <> b",
    "p10_texts": f"SELECT doc_id, {_consistent_sql('text')} AS canonical, {_consistent_sql('text')} <> text AS changed FROM documents",
    "p3_found": _P3,
    "p7_found": _P7 + "SELECT DISTINCT ev.tab AS eval_table, ev.id AS eval_id, tr.id AS train_record_id FROM near JOIN ev ON ev.w = near.wa JOIN tr ON tr.w = near.wb",
    "p7_report": _P7
    + """, hit AS (SELECT ev.tab, ev.id, bool_or(near.wa = near.wb) exact FROM near JOIN ev ON ev.w = near.wa GROUP BY 1, 2),
x AS (SELECT 'body_records' tab, record_id id, split, source FROM body_records WHERE split IN ('dev', 'test') UNION ALL SELECT 'graph_claim_pilot_manifest', pilot_id, 'pilot', NULL FROM graph_claim_pilot_manifest)
SELECT split, source, count(*) AS n_records, count(hit.id) AS n_overlapping, count(*) FILTER (WHERE exact) AS n_exact FROM x LEFT JOIN hit ON hit.tab = x.tab AND hit.id = x.id GROUP BY 1, 2""",
    "p6_found": _P6 + "SELECT s.keep_id, c.record_id AS copy_id FROM c JOIN s ON c.b = s.b AND c.i = s.i AND c.e = s.e WHERE c.record_id <> s.keep_id",
    "p6_records": _P6 + "SELECT keep_id AS record_id, copies FROM s",
}
