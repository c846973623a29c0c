"""SQL of the evaluation queries."""

from __future__ import annotations

import unicodedata

from ..functions.scoring import GENERIC
from ..functions.text import COMPARISON_CUES, GRAPH_TERMS, GREEK, RELATION_CUES, WHICH_TERMS

_SQ = r"lower(regexp_replace(regexp_replace({c}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1680}}\x{{2028}}\x{{2029}}\x{{85}}]+', ' ', 'g'), '^ | $', '', 'g'))"


def squeezed(c: str) -> str:
    return _SQ.format(c=c)


def alnum(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


_FIRST_CHECK = """v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, variant, claim_id ORDER BY checked_at, verification_id) rn FROM claim_verifications WHERE claim_id IS NOT NULL) WHERE rn = 1),
c AS (SELECT record_id, question_type, model, c.variant AS variant, c.claim_id AS claim_id FROM (SELECT record_id, question_type, model, unnest(claims) c FROM reaudit_outputs))"""
_ST = r"lower(regexp_replace(trim(status), '[\s-]+', '_', 'g'))"
_TWO = f"""WITH {_FIRST_CHECK}, w AS (SELECT record_id, variant, regexp_replace(claim_id, '^[A-Z]', '') no, {_ST} s FROM v),
t AS (SELECT a.s actual, b.s predicted FROM w a JOIN w b ON a.record_id = b.record_id AND a.no = b.no AND a.variant = 'text_only' AND b.variant = 'graph_assisted'
  WHERE a.s IN ('supported', 'contradicted', 'insufficient_evidence') AND b.s IN ('supported', 'contradicted', 'insufficient_evidence'))"""
_CLASSES = _TWO + """, k AS (SELECT unnest(['supported', 'contradicted', 'insufficient_evidence']) label),
x AS (SELECT label, count(*) FILTER (WHERE actual = label AND predicted = label) tp, count(*) FILTER (WHERE actual <> label AND predicted = label) fp, count(*) FILTER (WHERE actual = label AND predicted <> label) fn FROM k, t GROUP BY 1),
y AS (SELECT *, tp + fn support, tp / nullif(tp + fp, 0)::DOUBLE p, tp / nullif(tp + fn, 0)::DOUBLE r FROM x WHERE tp + fp + fn > 0),
cls AS (SELECT label, tp, fp, fn, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM y)"""
_ARMS = """WITH a AS (SELECT DISTINCT arm_row_id, route, question_id, model, final_disposition, stage7_id, answer,
  sha256(coalesce(question_id, '') || '|' || coalesce(array_to_string(evidence_snippet_ids, ','), '') || '|' || coalesce(model, '')) AS sig FROM evidence_arms)"""
_F1 = """list_sum([0] || list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w)))))"""
_PAIR = f"(SELECT pair_id, question_type, {tok('bge_answer')} a, {tok('hybrid_answer')} b FROM paired_answers WHERE bge_answer IS NOT NULL AND hybrid_answer IS NOT NULL)"
_F1X = f"CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0::DOUBLE * {_F1} / (len(a) + len(b)) END"
def _graph_score(c: str) -> str:
    n = alnum(c)
    terms = [f"(CASE WHEN contains({n}, '{t}') THEN {w} ELSE 0 END)" for t, w in GRAPH_TERMS.items()]
    which = " OR ".join(f"contains({n}, '{t}')" for t in WHICH_TERMS)
    bonus = [
        f"(CASE WHEN contains({n}, 'how does') OR contains({n}, 'what is the role') THEN 4 ELSE 0 END)",
        f"(CASE WHEN list_contains(string_split({n}, ' '), 'which') AND ({which}) THEN 2 ELSE 0 END)",
        f"(CASE WHEN len(string_split({n}, ' ')) >= 18 THEN 1 ELSE 0 END)",
    ]
    return "(" + " + ".join(terms + bonus) + ")"


def score_form(c: str) -> str:
    """F4 as SQL: letters with accents lose them and are set off, as decomposition and what follows it do."""
    marked, plain = [], []
    for cp in range(0xA0, 0x2100):
        d = unicodedata.normalize("NFKD", chr(cp))
        if d != chr(cp) and d[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:]):
            (marked if len(d) > 1 else plain).append((chr(cp), d[0]))
    both = marked + plain
    t = f"regexp_replace({c}, '([{''.join(x for x, _ in marked)}])', '\\1 ', 'g')"
    t = f"translate({t}, '{''.join(x for x, _ in both)}', '{''.join(y for _, y in both)}')"
    for letter, name in GREEK.items():
        t = f"replace({t}, '{letter}', ' {name} ')"
    t = f"lower({t})"
    for border in ("([a-z])([0-9])", "([0-9])([a-z])"):
        t = f"regexp_replace({t}, '{border}', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(?:a|an|the)\\b', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


_REL, _CMP = "|".join(RELATION_CUES.split()), "|".join(COMPARISON_CUES.split())
_D = "round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS max"
_SH = "sha256({k} || '|20260725')"

ORACLE = {
    "corpus_dedup": f"""WITH r AS (SELECT sha256({squeezed('text')}) k, trim(text) t, snippet_id, document_ids FROM candidate_snippets WHERE trim(coalesce(text, '')) <> ''),
d AS (SELECT k, count(DISTINCT x) n FROM (SELECT k, unnest(document_ids) x FROM r) WHERE x IS NOT NULL GROUP BY 1)
SELECT r.k AS snippet_key, arg_min(t, (snippet_id, t)) AS text, count(*) AS occurrences, coalesce(any_value(d.n), 0)::BIGINT AS n_documents FROM r LEFT JOIN d USING (k) GROUP BY 1""",
    "duplicate_groups": f"SELECT sha256({squeezed('text')}) AS group_key, count(*) AS n_members, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_occurrences": f"WITH k AS (SELECT sha256({squeezed('text')}) k FROM documents) SELECT count(k) AS n, count(DISTINCT k) AS n_distinct, count(k) - count(DISTINCT k) AS n_surplus FROM k",
    "missing_fields": """WITH n AS (SELECT count(*) n FROM evidence_arms), """
    + "u AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL{x}) AS n_missing FROM evidence_arms"
        for c, x in [("arm_row_id", ""), *[(c, f" OR trim({c}) = ''") for c in "arm_id stage7_id question_id question_type question route model answer final_disposition".split()], ("evidence_snippet_ids", " OR len(evidence_snippet_ids) = 0"), ("run_utc", "")]
    )
    + ") SELECT field, n_missing, n FROM u, n",
    "corpus_describe": f"SELECT coalesce(source, 'none') AS source, count(v) AS n, min(v) AS min, {_D} FROM (SELECT source, n_chars::DOUBLE v FROM documents WHERE n_chars IS NOT NULL) GROUP BY 1",
    "counts_two_level": "SELECT question_type, adaptive_route_selected, count(*) AS n FROM paired_answers GROUP BY 1, 2",
    "gold_relevance_map": "SELECT question_id, x AS snippet_id, row_number() OVER (PARTITION BY question_id ORDER BY x)::INT AS place FROM (SELECT DISTINCT question_id, unnest(evidence_snippet_ids) x FROM evidence_arms) WHERE x IS NOT NULL AND question_id IS NOT NULL",
    "dangling_references": "SELECT count(*) AS n_links, count(*) FILTER (WHERE x NOT IN (SELECT snippet_id FROM candidate_snippets WHERE snippet_id IS NOT NULL)) AS n_dangling FROM (SELECT unnest(hybrid_top5) x FROM graph_routing) WHERE x IS NOT NULL",
    "risk_features": rf"""WITH w AS (SELECT *, len(list_filter(regexp_split_to_array(question, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '')) n FROM graph_claim_pilot_manifest)
SELECT pilot_id, coalesce(n, 0)::INT AS n_words, coalesce(regexp_matches(question, '(?i)\b(?:{_REL})\b'), false) AS relation_cue, coalesce(regexp_matches(question, '(?i)\b(?:{_CMP})\b'), false) AS comparison_cue,
coalesce(regexp_matches(question, '(?i)\b(?:and|or|while|whereas|however|respectively)\b') AND n >= 12, false) AS clause_cue, coalesce(regexp_matches(question, '(?i)^\s*(?:how|why|describe|explain|what are the mechanisms?)\b'), false) AS explanation_cue,
rs AS risk_score, CASE WHEN rs <= 1 THEN 'low' WHEN rs <= 3 THEN 'medium' ELSE 'high' END AS risk_label FROM w, LATERAL (SELECT (CASE lower(trim(coalesce(question_type, 'missing'))) WHEN 'yesno' THEN 0 WHEN 'factoid' THEN 0 WHEN 'list' THEN 1 WHEN 'summary' THEN 2 ELSE 1 END
  + coalesce(regexp_matches(question, '(?i)\b(?:{_REL})\b'), false)::INT + coalesce(regexp_matches(question, '(?i)\b(?:{_CMP})\b'), false)::INT + coalesce(regexp_matches(question, '(?i)\b(?:and|or|while|whereas|however|respectively)\b') AND n >= 12, false)::INT
  + coalesce(regexp_matches(question, '(?i)^\s*(?:how|why|describe|explain|what are the mechanisms?)\b'), false)::INT)::INT rs)""",
    "graph_lexicon_score": f"SELECT pilot_id, {_graph_score('question')} AS score FROM graph_claim_pilot_manifest",
    "uncertainty_buckets": "SELECT CASE WHEN retrieval_uncertainty_score < .4 THEN 'low' WHEN retrieval_uncertainty_score < .65 THEN 'medium' WHEN retrieval_uncertainty_score IS NOT NULL THEN 'high' END AS label, count(*) AS n, round(avg(retrieval_uncertainty_score), 6) AS mean_score FROM graph_claim_pilot_manifest GROUP BY 1",
    "stratified_sample": f"SELECT * FROM (SELECT question_type, pilot_id, row_number() OVER (PARTITION BY question_type ORDER BY {_SH.format(k='pilot_id::VARCHAR')}, pilot_id) AS pick FROM graph_claim_pilot_manifest) WHERE pick <= 20",
    "pool_cascade": """WITH p AS (SELECT *, retrieval_uncertainty_label l, retrieval_uncertainty_score s FROM graph_claim_pilot_manifest WHERE retrieval_uncertainty_label IN ('high', 'medium', 'low')),
o AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY CASE l WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN s IS NULL THEN 1 ELSE 0 END, CASE WHEN l = 'low' THEN s ELSE -s END, pilot_id) pick FROM p)
SELECT question_type, pick, pilot_id, l AS selection_reason FROM o WHERE pick <= 3""",
    "quota_cells": f"""WITH p AS (SELECT *, {_graph_score('question')} g FROM graph_claim_pilot_manifest), a AS (SELECT *, row_number() OVER (PARTITION BY question_type, retrieval_uncertainty_label ORDER BY g DESC, pilot_id) ra FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY question_type, retrieval_uncertainty_label ORDER BY (ra = 1)::INT, g, pilot_id) rb FROM a)
SELECT question_type, retrieval_uncertainty_label, CASE WHEN ra = 1 THEN 'pick' ELSE 'control' END AS role, pilot_id FROM b WHERE ra = 1 OR rb = 1""",
    "hashed_grouped_split": f"""WITH x AS (SELECT record_id, ('0x' || md5({alnum('normalised_body')})[1:8])::BIGINT / 4294967296.0::DOUBLE h FROM body_records)
SELECT CASE WHEN h < .7 THEN 'train' WHEN h < .85 THEN 'dev' ELSE 'test' END AS assigned, count(*) AS n, min(record_id) AS first_record FROM x GROUP BY 1""",
    "split_overlap_counts": "WITH k AS (SELECT DISTINCT split s, unnest(ids) i FROM body_records) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n_keys FROM k a JOIN k b ON a.i = b.i AND a.s < b.s GROUP BY 1, 2",
    "split_leakage": f"SELECT md5({alnum('normalised_body')}) AS value_key, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM body_records GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "pilot_antijoin": "SELECT split, count(*) AS n FROM body_records WHERE record_id NOT IN (SELECT record_id FROM (SELECT record_id, unnest(ids) i FROM body_records) WHERE i IN (SELECT question_id FROM graph_claim_pilot_manifest WHERE question_id IS NOT NULL)) GROUP BY 1",
    "evidence_packets": """WITH b AS (SELECT snippet_id, min(text) t FROM candidate_snippets WHERE snippet_id IS NOT NULL GROUP BY 1),
p AS (SELECT arm_row_id, sid, min(pos) pos FROM (SELECT arm_row_id, unnest(evidence_snippet_ids) sid, unnest(range(len(evidence_snippet_ids))) pos FROM (SELECT DISTINCT arm_row_id, evidence_snippet_ids FROM evidence_arms)) WHERE sid IS NOT NULL GROUP BY 1, 2),
j AS (SELECT p.*, b.t, b.snippet_id IS NOT NULL known FROM p LEFT JOIN b ON b.snippet_id = p.sid), r AS (SELECT *, row_number() OVER (PARTITION BY arm_row_id ORDER BY pos) r FROM j WHERE known),
f AS (SELECT arm_row_id, md5(string_agg('[E' || r || '] ' || coalesce(t, ''), chr(10) || chr(10) ORDER BY r)) m, count(*) n FROM r WHERE r <= 5 GROUP BY 1)
SELECT j.arm_row_id, any_value(m) AS packet_md5, coalesce(any_value(n), 0)::INT AS n_evidence, count(*) FILTER (WHERE NOT known) AS n_missing FROM j LEFT JOIN f USING (arm_row_id) GROUP BY 1""",
    "claim_status_counts": f"""WITH {_FIRST_CHECK}, j AS (SELECT c.model, c.variant, CASE WHEN {_ST} IN ('supported', 'contradicted', 'insufficient_evidence') THEN {_ST} ELSE 'insufficient_evidence' END s FROM c LEFT JOIN v USING (record_id, variant, claim_id))
SELECT model, variant, count(*) AS n, count(*) FILTER (WHERE s = 'supported') AS n_supported, count(*) FILTER (WHERE s = 'contradicted') AS n_contradicted, count(*) FILTER (WHERE s = 'insufficient_evidence') AS n_insufficient_evidence FROM j GROUP BY 1, 2""",
    "claims_renumbered": "WITH k AS (SELECT record_id, list_filter(coalesce(claims, []), lambda c: trim(coalesce(c.text, '')) <> '') l FROM reaudit_outputs) SELECT record_id, len(l)::INT AS n_claims, coalesce(array_to_string(list_transform(range(1, len(l) + 1), lambda i: 'C' || i), ','), '') AS claim_ids, len(list_filter(l, lambda c: coalesce(lower(c.importance) = 'critical', false)))::INT AS n_critical FROM k",
    "issue_lists": """SELECT concat_ws(',', CASE WHEN raw_response IS NULL THEN 'no_reply' END, CASE WHEN coalesce(len(claims), 0) = 0 THEN 'no_claims' END, CASE WHEN coalesce(len(evidence), 0) = 0 THEN 'no_evidence' END, CASE WHEN json_repaired THEN 'repaired' END,
CASE WHEN usage IS NULL THEN 'no_usage' END, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' END) AS issues, count(*) AS n FROM reaudit_outputs GROUP BY 1""",
    "answer_token_f1": f"SELECT pair_id, round({_F1X}, 6) AS f1 FROM {_PAIR}",
    "yes_no_answers": r"""SELECT CASE WHEN regexp_matches(lower(bge_answer), '\byes\b') THEN 'yes' WHEN regexp_matches(lower(bge_answer), '\bno\b') THEN 'no' END AS bge, CASE WHEN regexp_matches(lower(hybrid_answer), '\byes\b') THEN 'yes' WHEN regexp_matches(lower(hybrid_answer), '\bno\b') THEN 'no' END AS hybrid,
count(*) AS n FROM paired_answers WHERE question_type = 'yesno' GROUP BY 1, 2""",
    "macro_token_f1": f"SELECT round(avg(m), 6) AS macro_mean, count(*) AS n_groups FROM (SELECT question_type, avg({_F1X}) m FROM {_PAIR} GROUP BY 1)",
    "confusion_matrix": _TWO + "SELECT actual, count(*) FILTER (WHERE predicted = 'supported') AS pred_supported, count(*) FILTER (WHERE predicted = 'contradicted') AS pred_contradicted, count(*) FILTER (WHERE predicted = 'insufficient_evidence') AS pred_insufficient_evidence FROM t GROUP BY 1",
    "class_scores": _CLASSES + " SELECT * FROM cls",
    "averaged_f1": _CLASSES + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM cls WHERE support > 0 AND f1 IS NOT NULL",
    "annotator_agreement": _TWO
    + """, n AS (SELECT count(*)::DOUBLE n, count(*) FILTER (WHERE actual = predicted) s FROM t), e AS (SELECT sum(a * b) pe FROM (SELECT label, count(*) FILTER (WHERE actual = label) / (SELECT n FROM n) a, count(*) FILTER (WHERE predicted = label) / (SELECT n FROM n) b FROM t, (SELECT unnest(['supported', 'contradicted', 'insufficient_evidence']) label) GROUP BY 1))
SELECT n::BIGINT AS n, (n - s)::BIGINT AS n_disagree, round(s / n, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1 ELSE (s / n - pe) / (1 - pe) END, 6) AS kappa, (SELECT count(*) FROM t WHERE predicted = 'supported' AND actual <> 'supported') AS n_false,
  round((SELECT count(*) FILTER (WHERE actual <> 'supported') / count(*)::DOUBLE FROM t WHERE predicted = 'supported'), 6) AS false_rate FROM n, e""",
    "merged_annotations": """WITH a AS (SELECT stage7_id, min(final_disposition) d FROM evidence_arms WHERE route = 'hybrid_baseline' GROUP BY 1), b AS (SELECT stage7_id, min(final_disposition) d FROM evidence_arms WHERE route <> 'hybrid_baseline' GROUP BY 1)
SELECT CASE WHEN a.stage7_id IS NULL THEN 'only_b' WHEN b.stage7_id IS NULL THEN 'only_a' ELSE 'both' END AS found_in, a.d = b.d AS agree, count(*) AS n FROM a FULL JOIN b ON a.stage7_id = b.stage7_id GROUP BY 1, 2""",
    "blinded_packet": """WITH k AS (SELECT record_id, list_filter(coalesce(claims, []), lambda c: c IS NOT NULL) l FROM reaudit_outputs),
x AS (SELECT record_id, c.claim_id ci, coalesce(c.text, '') t FROM (SELECT record_id, unnest(l) c FROM k) UNION ALL SELECT record_id, 'NO-CLAIM', '' FROM k WHERE len(l) = 0),
y AS (SELECT sha256('packet|' || record_id || '/' || ci || '|20260725')[1:10] blind_id, t FROM x) SELECT blind_id, t AS claim, sha256(blind_id || '|20260725') AS sheet_order FROM y""",
    "job_dedup": _ARMS + " SELECT 'JOB-' || upper(sig[1:16]) AS job_id, count(DISTINCT arm_row_id) AS n_arms, min(arm_row_id) AS first_arm, string_agg(DISTINCT route, ',' ORDER BY route) AS conditions FROM a GROUP BY sig",
    "batch_plan": _ARMS + ", j AS (SELECT min(arm_row_id) f FROM a GROUP BY sig), o AS (SELECT f, row_number() OVER (ORDER BY f) r FROM j) SELECT ceil(r / 6.0)::BIGINT AS batch_index, count(*) AS n_jobs, min(r) AS first_order, min(f) AS first_arm FROM o GROUP BY 1",
    "arm_fanout": _ARMS + ", f AS (SELECT sig, arg_min(final_disposition, arm_row_id) d, min(arm_row_id) m FROM a GROUP BY 1), g AS (SELECT f.sig, a.final_disposition AS d FROM f JOIN a ON a.sig = f.sig AND a.arm_row_id = f.m) SELECT route, g.d AS job_disposition, count(*) AS n_arms FROM a JOIN g USING (sig) GROUP BY 1, 2",
    "checkpoint_last_wins": "SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY record_id, variant, claim_id ORDER BY checked_at DESC, verification_id DESC) r FROM claim_verifications WHERE claim_id IS NOT NULL) WHERE r = 1 GROUP BY 1",
    "resume_antijoin": f"WITH {_FIRST_CHECK} SELECT model, count(*) AS n_open FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.record_id = c.record_id AND v.variant = c.variant AND v.claim_id = c.claim_id) GROUP BY 1",
    "request_groups": "SELECT n_items, count(*) AS n_groups FROM (SELECT record_id, variant, count(*) n_items FROM (SELECT DISTINCT * FROM claim_verifications) GROUP BY 1, 2) GROUP BY 1",
    "token_usage_totals": "WITH u AS (SELECT model, unnest(map_entries(usage)) e FROM reaudit_outputs) SELECT model, e.key AS name, round(sum(e.value), 6) AS total, count(e.value) AS n FROM u GROUP BY 1, 2",
    "latency_describe": f"SELECT model, count(v) AS n, min(v) AS min, {_D} FROM (SELECT model, latency_ms v FROM reaudit_outputs WHERE latency_ms IS NOT NULL) GROUP BY 1",
    "config_ranking": _TWO.replace("SELECT a.s actual", "SELECT a.record_id record_id, a.s actual")
    + """, k AS (SELECT model, count(*) FILTER (WHERE actual = 'insufficient_evidence' AND predicted = actual) / nullif(count(*) FILTER (WHERE actual = 'insufficient_evidence'), 0)::DOUBLE ir,
  count(*) FILTER (WHERE predicted = 'supported' AND actual <> predicted) / nullif(count(*) FILTER (WHERE predicted = 'supported'), 0)::DOUBLE fs, count(*) FILTER (WHERE actual = 'contradicted' AND predicted = actual) / nullif(count(*) FILTER (WHERE actual = 'contradicted'), 0)::DOUBLE cr
  FROM t JOIN reaudit_outputs USING (record_id) GROUP BY 1),
f AS (SELECT model, avg(CASE WHEN a > 0 AND p > 0 THEN 2.0::DOUBLE * h / (a + p) END) mf FROM (SELECT model, l, count(*) FILTER (WHERE actual = l AND predicted = l) h, count(*) FILTER (WHERE actual = l) a, count(*) FILTER (WHERE predicted = l) p
  FROM t JOIN reaudit_outputs USING (record_id), (SELECT unnest(['supported', 'contradicted', 'insufficient_evidence']) l) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT model, round(avg(latency_ms), 6) latency FROM reaudit_outputs GROUP BY 1),
x AS (SELECT m.model, latency, round(ir, 6) insufficient_recall, round(fs, 6) false_support_rate, round(cr, 6) contradicted_recall, round(mf, 6) macro_f1 FROM m LEFT JOIN k ON k.model = m.model LEFT JOIN f ON f.model = m.model)
SELECT *, row_number() OVER (ORDER BY coalesce(insufficient_recall, -1) DESC, coalesce(false_support_rate, 1), coalesce(contradicted_recall, -1) DESC, coalesce(macro_f1, -1) DESC, latency ASC NULLS LAST, model)::INT AS place FROM x""",
    "paired_pivot": _ARMS + """, l AS (SELECT stage7_id, max(length(answer)) FILTER (WHERE coalesce(route <> 'hybrid_baseline', true))::DOUBLE g, max(length(answer)) FILTER (WHERE route = 'hybrid_baseline')::DOUBLE b FROM a GROUP BY 1)
SELECT count(*) AS n_pairs, round(avg(g - b), 6) AS mean_difference, round(avg(CASE WHEN g > b THEN 1.0::DOUBLE WHEN g = b THEN 0.5 ELSE 0 END), 6) AS win_share FROM l WHERE g IS NOT NULL AND b IS NOT NULL""",
    "bootstrap_interval": """WITH v AS (SELECT coalesce(question_type, 'none') s, pilot_id::VARCHAR k, retrieval_uncertainty_score - 0.5 v FROM graph_claim_pilot_manifest WHERE retrieval_uncertainty_score IS NOT NULL),
h AS (SELECT s, v, c, md5(c || '|' || k || '|20260726') h FROM v, (SELECT unnest(range(1250)) c)), u AS (SELECT s, v, c * 8 + j b, ('0x' || h[4 * j + 1:4 * j + 4])::INT u FROM h, (SELECT unnest(range(8)) j)),
w AS (SELECT s, v, b, ((u >= 24109)::INT + (u >= 48219)::INT + (u >= 60273)::INT + (u >= 64292)::INT + (u >= 65296)::INT + (u >= 65497)::INT + (u >= 65531)::INT + (u >= 65535)::INT) w FROM u),
m AS (SELECT s, b, sum(v * w) / sum(w) m FROM w WHERE w > 0 GROUP BY 1, 2), g AS (SELECT b, round(avg(m), 10) mean FROM m GROUP BY 1), r AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 r FROM g)
SELECT count(*) AS n, round(avg(mean), 6) AS mean, round(max(mean) FILTER (WHERE r = 250), 6) AS lower, round(max(mean) FILTER (WHERE r = 9750), 6) AS upper, round(avg((mean > 0)::INT), 6) AS win_share FROM r""",
    "snippet_documents": f"SELECT DISTINCT sha256({squeezed('text')}) AS snippet_key, x AS document_id FROM (SELECT text, unnest(document_ids) x FROM candidate_snippets WHERE trim(coalesce(text, '')) <> '') WHERE x IS NOT NULL",
    "corpus_rejects": "SELECT count(*) FILTER (WHERE trim(coalesce(journal, '')) <> '') AS n_kept, count(*) FILTER (WHERE trim(coalesce(journal, '')) = '') AS n_rejected FROM documents",
    "duplicate_members": f"SELECT group_key, doc_id AS member, row_number() OVER (PARTITION BY group_key ORDER BY doc_id)::INT AS place FROM (SELECT *, sha256({squeezed('text')}) group_key, count(*) OVER (PARTITION BY sha256({squeezed('text')})) n FROM documents WHERE text IS NOT NULL) WHERE n > 1",
    "duplicate_report": f"SELECT group_key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY doc_id) r, count(*) OVER (PARTITION BY group_key) n FROM (SELECT doc_id, sha256({squeezed('text')}) group_key FROM documents WHERE text IS NOT NULL)) WHERE n > 1 AND r <= 25 GROUP BY 1",
    "blinded_key": """WITH k AS (SELECT record_id, list_filter(coalesce(claims, []), lambda c: c IS NOT NULL) l FROM reaudit_outputs),
x AS (SELECT record_id, c.claim_id claim_id FROM (SELECT record_id, unnest(l) c FROM k) UNION ALL SELECT record_id, 'NO-CLAIM' FROM k WHERE len(l) = 0) SELECT sha256('packet|' || record_id || '/' || claim_id || '|20260725')[1:10] AS blind_id, record_id, claim_id FROM x""",
    "human_reference": f"WITH {_FIRST_CHECK}, i AS (SELECT record_id, c.variant AS variant, c.claim_id AS claim_id, c.importance AS importance FROM (SELECT record_id, unnest(claims) c FROM reaudit_outputs)) SELECT {_ST} AS label, importance, count(*) AS n FROM i JOIN v USING (record_id, variant, claim_id) GROUP BY 1, 2",
    "job_arms": _ARMS + " SELECT DISTINCT 'JOB-' || upper(sig[1:16]) AS job_id, arm_row_id FROM a",
    "request_items": "SELECT *, ceil(place / 20.0)::BIGINT AS part FROM (SELECT *, row_number() OVER (PARTITION BY record_id, variant ORDER BY verification_id)::INT AS place FROM (SELECT DISTINCT record_id, variant, verification_id FROM claim_verifications))",
    "three_way_pivot": _ARMS + ", c AS (SELECT stage7_id, CASE WHEN final_disposition = 'abstain' THEN 'abstained' WHEN route = 'hybrid_baseline' THEN 'base' ELSE 'graph' END c, length(answer)::INT v FROM a) SELECT stage7_id, max(v) FILTER (WHERE c = 'base') AS base, max(v) FILTER (WHERE c = 'graph') AS graph, max(v) FILTER (WHERE c = 'abstained') AS abstained FROM c GROUP BY 1",
    "largest_differences": "SELECT pair_id, (length(hybrid_answer) - length(bge_answer))::INT AS difference FROM (SELECT DISTINCT * FROM paired_answers) WHERE hybrid_answer IS NOT NULL AND bge_answer IS NOT NULL ORDER BY abs(length(hybrid_answer) - length(bge_answer)) DESC, pair_id LIMIT 6",
    "coverage": "SELECT question_type, count(*) AS n, count(*) FILTER (WHERE r) AS n_released, round(avg(r::INT), 6) AS released_rate, count(*) FILTER (WHERE e) AS n_bare, round(avg(e::INT), 6) AS bare_rate FROM (SELECT DISTINCT arm_row_id, question_type, coalesce(lower(trim(final_disposition)) = 'release', false) r, coalesce(len(evidence_snippet_ids), 0) = 0 e FROM evidence_arms) GROUP BY 1",
    "mean_evidence": "SELECT route, count(*) AS n, round(avg(coalesce(len(evidence_snippet_ids), 0)), 6) AS mean_size FROM (SELECT DISTINCT * FROM evidence_arms) GROUP BY 1",
    "distinct_claims": "WITH c AS (SELECT question_id q, lower(trim(c.text)) t FROM (SELECT question_id, unnest(claims) c FROM reaudit_outputs)) SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM (SELECT DISTINCT q, t FROM c)) AS n_distinct",
    "released_unsupported": f"WITH {_FIRST_CHECK}, b AS (SELECT record_id, bool_or(coalesce(lower(trim(status)) <> 'supported', true)) bad FROM v GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE deleted_at IS NULL) AS n_released, count(*) FILTER (WHERE deleted_at IS NULL AND coalesce(bad, false)) AS n_released_unsupported FROM reaudit_outputs LEFT JOIN b USING (record_id)",
    "completeness": """WITH g AS (SELECT record_id, list_sort(list(DISTINCT variant || '/' || claim_id)) g FROM claim_verifications WHERE claim_id IS NOT NULL GROUP BY 1),
w AS (SELECT *, list_transform(claims, lambda c: c.variant || '/' || c.claim_id) k FROM reaudit_outputs),
x AS (SELECT coalesce(trim(raw_response) <> '' AND len(claims) > 0 AND len(list_filter(claims, lambda c: trim(coalesce(c.text, '')) = '' OR c.claim_id IS NULL)) = 0 AND len(list_distinct(k)) = len(k), false) a, coalesce(list_sort(list_distinct(k)) = g, false) v FROM w LEFT JOIN g USING (record_id))
SELECT a AS answer_complete, v AS verification_complete, count(*) AS n FROM x GROUP BY 1, 2""",
    "ordered_labels": "SELECT question_type, pilot_id, row_number() OVER (PARTITION BY question_type ORDER BY CASE retrieval_uncertainty_label WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, retrieval_uncertainty_score DESC NULLS LAST, pilot_id)::INT AS place FROM graph_claim_pilot_manifest",
    "pilot_lookup": "WITH f AS (SELECT question_id, min(record_id) record_id FROM graph_routing GROUP BY 1) SELECT pilot_id, p.question_id, f.record_id, f.record_id IS NOT NULL AS found FROM graph_claim_pilot_manifest p LEFT JOIN f ON f.question_id = p.question_id WHERE p.question_id IS NOT NULL",
    "public_questions": "SELECT pilot_id, question_type, question FROM graph_claim_pilot_manifest",
    "missing_gold": "SELECT question_type, count(*) AS n_missing, min(pair_id) AS first_missing FROM (SELECT DISTINCT pair_id, question_type FROM paired_answers WHERE hybrid_answer IS NULL) GROUP BY 1",
    # items of an answer as rows, their aliases as rows, matched against the other answer's aliases
    "factoid_reciprocal_rank": rf"""WITH p AS (SELECT pair_id, regexp_replace(bge_answer, '^\s+|\s+$', '', 'g') t, hybrid_answer h FROM paired_answers WHERE question_type = 'factoid' AND bge_answer IS NOT NULL AND hybrid_answer IS NOT NULL),
q AS (SELECT pair_id, regexp_replace(t, '^[-*•]\s*', '') t FROM p WHERE t <> '[]'),
l AS (SELECT pair_id, CASE WHEN regexp_matches(t, '[;\n]') THEN regexp_split_to_array(t, '[;\n]') WHEN regexp_matches(t, '\b\d+[.)]\s+') THEN regexp_split_to_array(t, '\b\d+[.)]\s+')
  WHEN contains(t, ',') AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) < 40 THEN string_split(t, ',') ELSE [t] END l FROM q),
i AS (SELECT pair_id, trim(regexp_replace(unnest(l), '^\s+|\s+$', '', 'g'), '[]''" ') x, unnest(range(len(l))) pos FROM l), f AS (SELECT *, {score_form('x')} f FROM i),
n AS (SELECT pair_id, x, row_number() OVER (PARTITION BY pair_id ORDER BY pos) r FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, f ORDER BY pos) d FROM f WHERE f <> '') WHERE d = 1),
raw AS (SELECT pair_id, r, unnest([x] || regexp_extract_all(x, '([^()]*)\(([^()]*)\)', 1) || regexp_extract_all(x, '([^()]*)\(([^()]*)\)', 2)) v FROM (SELECT pair_id, r, x FROM n UNION ALL SELECT pair_id, 0, h FROM p)),
a AS (SELECT DISTINCT pair_id, r, f, false g FROM (SELECT pair_id, r, {score_form('v')} f FROM raw) WHERE f <> ''),
b AS (SELECT * FROM a UNION SELECT pair_id, r, array_to_string(list_filter(string_split(f, ' '), lambda w: NOT list_contains(string_split('{GENERIC}', ' '), w)), ' '), true FROM a),
w AS (SELECT pair_id, r, f, g, string_split(f, ' ') a FROM b WHERE f <> ''),
m AS (SELECT x.pair_id, x.r, bool_or(x.f = y.f AND NOT x.g AND NOT y.g) strict, bool_or(x.f = y.f OR 2.0::DOUBLE * list_sum([0] || list_transform(list_distinct(x.a), lambda k: least(len(list_filter(x.a, lambda z: z = k)), len(list_filter(y.a, lambda z: z = k))))) / (len(x.a) + len(y.a)) >= 0.85) lenient
  FROM w x JOIN w y ON y.pair_id = x.pair_id AND y.r = 0 WHERE x.r > 0 GROUP BY 1, 2)
SELECT p.pair_id, round(coalesce(1.0::DOUBLE / min(r) FILTER (WHERE lenient), 0), 6) AS lenient, round(coalesce(1.0::DOUBLE / min(r) FILTER (WHERE strict), 0), 6) AS strict FROM p LEFT JOIN m ON m.pair_id = p.pair_id GROUP BY 1""",
    # longest common subsequences by rows: a row's cell is the best of those to its left and above
    "rouge_l_pairs": f"""WITH RECURSIVE p AS (SELECT pair_id, list_filter(string_split({score_form('bge_answer')}, ' '), lambda w: w <> '') a, list_filter(string_split({score_form('hybrid_answer')}, ' '), lambda w: w <> '') b
  FROM paired_answers WHERE bge_answer IS NOT NULL AND hybrid_answer IS NOT NULL),
d AS (SELECT pair_id, a, b, 0 i, list_transform(range(0, len(b) + 1), lambda j: 0) r FROM p
  UNION ALL SELECT pair_id, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN 0 WHEN b[k] = a[i + 1] THEN greatest(r[k + 1], r[k] + 1) ELSE r[k + 1] END))) FROM d WHERE i < len(a))
SELECT pair_id, round(CASE WHEN r[len(b) + 1] > 0 THEN 2.0::DOUBLE * r[len(b) + 1] / (len(a) + len(b)) ELSE 0 END, 6) AS rouge_l FROM d WHERE i = len(a)""",
    "smoke_combination": """WITH o AS (SELECT * FROM (SELECT question_type t, pilot_id k, retrieval_uncertainty_label f, row_number() OVER (PARTITION BY question_type ORDER BY pilot_id) r FROM graph_claim_pilot_manifest WHERE question_type IS NOT NULL) WHERE r <= 6),
x AS (SELECT [a.t, b.t, c.t, d.t] ts, [a.k, b.k, c.k, d.k] ks, [a.f, b.f, c.f, d.f] fs FROM o a, o b, o c, o d WHERE a.t = 'factoid' AND b.t = 'list' AND c.t = 'summary' AND d.t = 'yesno'),
y AS (SELECT *, abs(len(list_filter(fs, lambda f: f = 'low')) - 1) + abs(len(list_filter(fs, lambda f: f = 'medium')) - 1) + abs(len(list_filter(fs, lambda f: f = 'high')) - 2) dist FROM x ORDER BY dist, ks LIMIT 1)
SELECT dist::INT AS distance, unnest(ts) AS question_type, unnest(ks) AS pilot_id, unnest(fs) AS retrieval_uncertainty_label FROM y""",
    "selection_counterfactual": """WITH x AS (SELECT record_id, list_filter(coalesce(hybrid_top5, []::VARCHAR[]), lambda s: s IS NOT NULL) a, list_filter(coalesce(list_transform(selection_trace, lambda t: t.snippet_id), []::VARCHAR[]), lambda s: s IS NOT NULL) b FROM graph_routing)
SELECT record_id, len(list_filter(list_distinct(b), lambda s: NOT list_contains(a, s)))::INT AS n_added, len(list_filter(list_distinct(a), lambda s: NOT list_contains(b, s)))::INT AS n_dropped, list_sort(list_distinct(a)) <> list_sort(list_distinct(b)) AS set_changed, a <> b AS list_changed FROM x""",
    "validator_checks": "WITH "
    + "x AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE NOT coalesce({c}, false)) f FROM reaudit_outputs"
        for n, c in [
            ("record_has_id", "record_id IS NOT NULL"), ("mode_is_known", "response_mode IN ('json', 'plain')"), ("has_claims", "len(claims) > 0"), ("has_reply", "raw_response IS NOT NULL"),
            ("deleted_after_arrival", "deleted_at IS NULL OR deleted_at > arrived_at"), ("claim_ids_distinct", "len(list_distinct(list_transform(claims, lambda c: c.variant || '/' || c.claim_id))) = len(claims)"), ("latency_positive", "latency_ms > 0"),
        ]
    )
    + ") SELECT check_name, f = 0 AS passed, f AS n_failed FROM x",
}
