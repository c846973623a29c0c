"""Corpus, sampling, evidence, scoring, agreement, job and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import annotate, bootstrap, corpus, evidence, flatten, graph, jobs, metrics, sampling, validate
from ..session import environment_profile, table
from .evaluation_sql import ORACLE  # noqa: F401  (the registry reads it here)

STATUSES = ["supported", "contradicted", "insufficient_evidence"]
SEED = 20260725


# corpus


def corpus_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "candidate_snippets")
    return corpus.snippet_bank(d, "text", "document_ids", "snippet_id")


def snippet_documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.snippet_documents(table(spark, sf, "candidate_snippets"), "text", "document_ids")


def corpus_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rejected(table(spark, sf, "documents"), "journal")


def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_groups(table(spark, sf, "documents"), "text", "doc_id")


def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_members(table(spark, sf, "documents"), "text", "doc_id")


def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 members of each group, for a report."""
    return corpus.report_lists(duplicate_members(spark, sf))


def duplicate_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_occurrences(table(spark, sf, "documents"), "text")


def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.missing_fields(table(spark, sf, "evidence_arms"))


def corpus_describe(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.describe(table(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit("none"))), "n_chars", ["source"])


def counts_two_level(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "paired_answers").groupBy("question_type", "adaptive_route_selected").agg(F.count(F.lit(1)).alias("n"))


def gold_relevance_map(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "evidence_arms").select("question_id", F.explode("evidence_snippet_ids").alias("snippet_id"))
    return corpus.gold_map(links, "question_id", "snippet_id")


def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "graph_routing").select(F.explode("hybrid_top5").alias("snippet_id"))
    return corpus.dangling(links, table(spark, sf, "candidate_snippets"), "snippet_id", "snippet_id")


def content_hash_documents(spark: SparkSession, sf: str) -> DataFrame:
    return validate.content_hash(table(spark, sf, "documents"))


# text features


def risk_features(spark: SparkSession, sf: str) -> DataFrame:
    """Query-only cues."""
    q = F.col("question")
    words = text.word_count(q)
    return table(spark, sf, "graph_claim_pilot_manifest").select(
        "pilot_id",
        words.alias("n_words"),
        text.has_cue(q, text.RELATION_CUES).alias("relation_cue"),
        text.has_cue(q, text.COMPARISON_CUES).alias("comparison_cue"),
        (text.has_cue(q, text.CLAUSE_CUES) & (words >= 12)).alias("clause_cue"),
        text.starts_explaining(q).alias("explanation_cue"),
        text.risk_score(F.col("question_type"), q).alias("risk_score"),
        text.risk_label(text.risk_score(F.col("question_type"), q)).alias("risk_label"),
    )


def graph_lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_claim_pilot_manifest").select("pilot_id", text.graph_score(F.col("question")).alias("score"))


def uncertainty_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = text.bucket(F.col("retrieval_uncertainty_score"), [0.40, 0.65], ["low", "medium", "high"])
    return table(spark, sf, "graph_claim_pilot_manifest").groupBy(b.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("retrieval_uncertainty_score"), 6).alias("mean_score"))


# sampling


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "graph_claim_pilot_manifest")
    return sampling.stratified_sample(p, "question_type", "pilot_id", 20, SEED).select("question_type", "pilot_id", "pick")


def pool_cascade(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "graph_claim_pilot_manifest")
    label, score = F.col("retrieval_uncertainty_label"), F.col("retrieval_uncertainty_score")
    down, up = [F.desc_nulls_last(score), F.asc("pilot_id")], [F.asc_nulls_last(score), F.asc("pilot_id")]
    pools = [("high", label == "high", down), ("medium", label == "medium", down), ("low", label == "low", up)]
    return sampling.pool_cascade(p, "question_type", pools, 3).select("question_type", "pick", "pilot_id", "selection_reason")


def quota_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "graph_claim_pilot_manifest").withColumn("g", text.graph_score(F.col("question")))
    x = sampling.pick_with_control(p, ["question_type", "retrieval_uncertainty_label"], "pilot_id", [F.desc("g")], [F.asc("g")])
    return x.select("question_type", "retrieval_uncertainty_label", "role", "pilot_id")


def smoke_combination(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "graph_claim_pilot_manifest").where("question_type is not null")
    return sampling.best_combination(p, "question_type", "pilot_id", "retrieval_uncertainty_label", {"low": 1, "medium": 1, "high": 2})


def greedy_grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    """U3/J21 over the question types: rows per split; bodies with a pilot question among their ids are pinned to dev."""
    r = table(spark, sf, "body_records")
    pilot = table(spark, sf, "graph_claim_pilot_manifest").select("question_id").distinct()
    hit = r.select("record_id", F.explode("ids").alias("question_id")).join(pilot, "question_id", "left_semi").select("record_id").distinct()
    b = r.join(hit.withColumn("pin", F.lit(True)), "record_id", "left").select("record_id", F.coalesce("question_type", F.lit("none")).alias("question_type"), F.sha2(text.alnum(F.col("normalised_body")), 256).alias("body_key"), "pin")
    s = sampling.greedy_split(b, "question_type", "body_key", SEED, pinned="pin").select(F.col("question_type").alias("_t"), F.col("body_key").alias("_k"), "split")
    same = (F.col("question_type") == F.col("_t")) & F.col("body_key").eqNullSafe(F.col("_k"))
    return b.join(s, same).groupBy("question_type", F.col("split").alias("assigned")).agg(F.count(F.lit(1)).alias("n"))


def hashed_grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "body_records")
    return b.groupBy(sampling.hash_split(text.alnum(F.col("normalised_body"))).alias("assigned")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"))


def split_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "body_records").select("split", F.explode("ids").alias("question_id"))
    return sampling.split_overlaps(b, "split", "question_id")


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.leaking_values(table(spark, sf, "body_records"), "split", F.md5(text.alnum(F.col("normalised_body"))))


def pilot_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Records none of whose ids is a pilot question."""
    b = table(spark, sf, "body_records").select("record_id", F.explode("ids").alias("question_id"))
    hit = b.join(table(spark, sf, "graph_claim_pilot_manifest").select("question_id").distinct(), "question_id", "left_semi").select("record_id").distinct()
    return table(spark, sf, "body_records").join(hit, "record_id", "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# evidence and claims


def evidence_packets(spark: SparkSession, sf: str) -> DataFrame:
    arms = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"])
    p = evidence.evidence_packets(arms, "arm_row_id", "evidence_snippet_ids", table(spark, sf, "candidate_snippets"), "snippet_id", "text")
    return p.select("arm_row_id", F.md5(text.evidence_text(F.col("packet"))).alias("packet_md5"), F.coalesce(F.size("packet"), F.lit(0)).alias("n_evidence"), "n_missing")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reaudit_outputs").select("record_id", "question_type", "model", F.explode("claims").alias("c")).select("record_id", "question_type", "model", "c.variant", "c.claim_id", "c.importance")


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "claim_verifications").where("claim_id is not null").select("record_id", "variant", "claim_id", "status", "checked_at", "verification_id")
    return annotate.first_of_key(v, ["record_id", "variant", "claim_id"], ["checked_at", "verification_id"])


def claim_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = evidence.verified_claims(_claims(spark, sf), _checks(spark, sf), ["record_id", "variant", "claim_id"], STATUSES, "insufficient_evidence")
    return evidence.status_counts(c, ["model", "variant"], "status", STATUSES)


def raw_reply_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts recovered from raw replies, repaired where they are no JSON."""
    r = table(spark, sf, "reaudit_outputs").where("response_mode = 'json' and raw_response is not null").select("record_id", "raw_response")
    fixed = F.coalesce(F.when(F.try_parse_json(F.col("raw_response")).isNotNull(), F.col("raw_response")), scoring.repair_json("raw_response"))
    r = r.select("record_id", fixed.alias("reply"))
    both = [F.transform(evidence.reply_claims(F.col("reply"), v), lambda c, v=v: F.struct(F.lit(v).alias("variant"), c["claim_id"].alias("claim_id"), c["status"].alias("status"))) for v in ("text_only", "graph_assisted")]
    none = F.expr("cast(array() as array<struct<variant:string,claim_id:string,status:string>>)")
    x = r.select("record_id", F.explode(F.concat(*[F.coalesce(b, none) for b in both])).alias("c")).select("record_id", "c.*")
    return x.groupBy("variant", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_records"))


def claims_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reaudit_outputs").select("record_id", evidence.renumbered_claims(F.col("claims")).alias("claims"))
    return r.select("record_id", F.size("claims").alias("n_claims"), F.array_join(F.transform("claims", lambda c: c["claim_id"]), ",").alias("claim_ids"), F.size(F.filter("claims", lambda c: c["importance"] == "critical")).alias("n_critical"))


def issue_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reaudit_outputs")
    rules = {
        "no_reply": F.col("raw_response").isNull(), "no_claims": F.coalesce(F.size("claims"), F.lit(0)) <= 0, "no_evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "repaired": F.col("json_repaired"), "no_usage": F.col("usage").isNull(), "deleted": F.col("deleted_at").isNotNull(),
    }
    return r.groupBy(F.array_join(evidence.issue_codes(rules), ",").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


# scoring


def answer_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """F9 between the two answers of a pair."""
    p = table(spark, sf, "paired_answers").where("bge_answer is not null and hybrid_answer is not null")
    return p.select("pair_id", F.round(text.multiset_f1(text.tokens(F.col("bge_answer")), text.tokens(F.col("hybrid_answer"))), 6).alias("f1"))


def yes_no_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "paired_answers").where("question_type = 'yesno'")
    return p.groupBy(text.yes_no(F.col("bge_answer")).alias("bge"), text.yes_no(F.col("hybrid_answer")).alias("hybrid")).agg(F.count(F.lit(1)).alias("n"))


def rouge_l_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "paired_answers").where("bge_answer is not null and hybrid_answer is not null")
    form = lambda c: F.filter(F.split(scoring.normal_form(F.col(c)), " "), lambda w: w != "")
    return p.select("pair_id", form("bge_answer").alias("a"), F.array(form("hybrid_answer")).alias("r")).select("pair_id", F.round(scoring.rouge_l("a", "r"), 6).alias("rouge_l"))


def list_f1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """List answers against the other answer's items by one-to-one matching."""
    p = table(spark, sf, "paired_answers").where("question_type = 'list' and bge_answer is not null and hybrid_answer is not null")
    p = p.select("pair_id", scoring.answer_items(scoring.decomposed(F.col("bge_answer"))).alias("a"), scoring.answer_items(scoring.decomposed(F.col("hybrid_answer"))).alias("b"))
    known = {c: F.transform(c, lambda x: text.aliases(x, scoring.GENERIC)).alias(f"{c}_alias") for c in ("a", "b")}
    p = p.select("pair_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), *known.values())
    return scoring.list_f1(p, "a_alias", "b_alias")


def factoid_reciprocal_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Place of the first item of an answer that matches the other answer, strict and lenient."""
    p = table(spark, sf, "paired_answers").where("question_type = 'factoid' and bge_answer is not null and hybrid_answer is not null")
    p = p.select("pair_id", scoring.answer_items(scoring.decomposed(F.col("bge_answer"))).alias("a"), text.aliases(scoring.decomposed(F.col("hybrid_answer"))).alias("strict_b"), text.aliases(scoring.decomposed(F.col("hybrid_answer")), scoring.GENERIC).alias("lenient_b"))
    p = p.select("pair_id", F.transform("a", lambda x: text.aliases(x)).alias("strict_a"), F.transform("a", lambda x: text.aliases(x, scoring.GENERIC)).alias("lenient_a"), "strict_b", "lenient_b")

    def rr(kind: str):
        hit = F.transform(f"{kind}_a", lambda x: text.aliases_match(x, F.col(f"{kind}_b"), kind == "lenient"))
        return F.round(F.coalesce(1.0 / F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)), F.lit(0.0)), 6).alias(kind)

    return p.select("pair_id", rr("lenient"), rr("strict"))


def macro_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "paired_answers").where("bge_answer is not null and hybrid_answer is not null")
    return metrics.macro_mean(p.select("question_type", text.multiset_f1(text.tokens(F.col("bge_answer")), text.tokens(F.col("hybrid_answer"))).alias("f1")), "question_type", "f1")


# agreement


def _two_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the two variants on claims of the same number, both in the status vocabulary."""
    v = _checks(spark, sf).select("record_id", "variant", F.regexp_replace("claim_id", "^[A-Z]", "").alias("no"), F.lower(F.regexp_replace(F.trim("status"), r"[\s-]+", "_")).alias("status"))
    a = v.where("variant = 'text_only'").select("record_id", "no", F.col("status").alias("actual"))
    b = v.where("variant = 'graph_assisted'").select("record_id", "no", F.col("status").alias("predicted"))
    return a.join(b, ["record_id", "no"])


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_two_verdicts(spark, sf), "actual", "predicted", STATUSES)


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_class(_two_verdicts(spark, sf), "actual", "predicted", STATUSES)


def averaged_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.averaged_f1(class_scores(spark, sf))


def annotator_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agreement(_two_verdicts(spark, sf), "actual", "predicted", STATUSES)


def merged_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The two answer runs' dispositions merged per question, with what only one side holds."""
    a = table(spark, sf, "evidence_arms").where("route = 'hybrid_baseline'").groupBy("stage7_id").agg(F.min("final_disposition").alias("d"))
    b = table(spark, sf, "evidence_arms").where("route <> 'hybrid_baseline'").groupBy("stage7_id").agg(F.min("final_disposition").alias("d"))
    return annotate.merge_annotations(a, b, "stage7_id", "d").groupBy("found_in", "agree").agg(F.count(F.lit(1)).alias("n"))


def blinded_packet(spark: SparkSession, sf: str) -> DataFrame:
    packet, _ = annotate.blinded_packet(table(spark, sf, "reaudit_outputs"), "record_id", "claims", SEED)
    return packet.select("blind_id", "claim", "sheet_order")


def blinded_key(spark: SparkSession, sf: str) -> DataFrame:
    """The private table that leads from the blind ids back to records and claims."""
    _, key = annotate.blinded_packet(table(spark, sf, "reaudit_outputs"), "record_id", "claims", SEED)
    return key


def human_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Blinded claims joined to a second reader's verdicts (here those of the verification run), by status and importance."""
    audit = _claims(spark, sf)
    reference = _checks(spark, sf).select("record_id", "variant", "claim_id", F.lower(F.regexp_replace(F.trim("status"), r"[\s-]+", "_")).alias("label"))
    return audit.join(reference, ["record_id", "variant", "claim_id"]).groupBy("label", "importance").agg(F.count(F.lit(1)).alias("n"))


# jobs and logs


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"])
    ids = F.array_join(F.coalesce("evidence_snippet_ids", F.array().cast("array<string>")), ",")
    return a.withColumn("job_signature", F.sha2(F.concat_ws("|", F.coalesce("question_id", F.lit("")), ids, F.coalesce("model", F.lit(""))), 256))


def job_dedup(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs.dedup_jobs(_arms(spark, sf), "job_signature", "arm_row_id", "route")
    return j.select(jobs.job_id(F.col("job_signature"), "JOB-").alias("job_id"), "n_arms", "first_arm", F.array_join("conditions", ",").alias("conditions"))


def job_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Every arm with its job."""
    return jobs.job_arms(_arms(spark, sf), "job_signature", "arm_row_id").select(jobs.job_id(F.col("job_signature"), "JOB-").alias("job_id"), "arm_row_id")


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs.dedup_jobs(_arms(spark, sf), "job_signature", "arm_row_id", "route")
    return jobs.batch_plan(j, "first_arm").groupBy("batch_index").agg(F.count(F.lit(1)).alias("n_jobs"), F.min("job_order").alias("first_order"), F.min("first_arm").alias("first_arm"))


def arm_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Arms carry the disposition of their job's first arm."""
    arms = _arms(spark, sf)
    first = jobs.last_written(arms.select("job_signature", (-F.col("arm_row_id")).alias("o"), "final_disposition"), "job_signature", ["o"]).select("job_signature", F.col("final_disposition").alias("job_disposition"))
    x = jobs.fan_out(arms.select("arm_row_id", "job_signature", "route"), first, "job_signature")
    return x.groupBy("route", "job_disposition").agg(F.count(F.lit(1)).alias("n_arms"))


def checkpoint_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "claim_verifications").where("claim_id is not null").select(F.concat_ws("/", F.col("record_id").cast("string"), "variant", "claim_id").alias("k"), "checked_at", "verification_id", "status")
    return jobs.last_written(v, "k", ["checked_at", "verification_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Claims without any verdict yet, per model."""
    done = table(spark, sf, "claim_verifications").where("claim_id is not null").select("record_id", "variant", "claim_id").distinct()
    return _claims(spark, sf).join(done, ["record_id", "variant", "claim_id"], "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("n_open"))


def request_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = jobs.request_groups(table(spark, sf, "claim_verifications").distinct(), ["record_id", "variant"], "verification_id")
    return g.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_groups"))


def request_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every verification with its place in the request of its record and variant."""
    v = table(spark, sf, "claim_verifications").select("record_id", "variant", "verification_id").distinct()
    return jobs.request_items(v, ["record_id", "variant"], "verification_id")


def token_usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.map_totals(table(spark, sf, "reaudit_outputs"), "usage", ["model"])


def latency_describe(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.describe(table(spark, sf, "reaudit_outputs"), "latency_ms", ["model"])


def config_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Models by five keys: recall of insufficient and false supports, recall of contradicted, macro F1, latency.

    Higher recall and F1 come first, fewer false supports and lower latency; a missing figure is the worst.
    """
    from pyspark.sql.window import Window

    two = _two_verdicts(spark, sf).join(table(spark, sf, "reaudit_outputs").select("record_id", "model"), "record_id")
    hit = {x: F.count_if((F.col("actual") == x) & (F.col("predicted") == x)) for x in STATUSES}
    of = {x: F.count_if(F.col("actual") == x) for x in STATUSES}
    said = {x: F.count_if(F.col("predicted") == x) for x in STATUSES}
    f1 = {x: F.when((of[x] > 0) & (said[x] > 0), F.try_divide(2.0 * hit[x], of[x] + said[x])) for x in STATUSES}
    known = two.where(F.col("actual").isin(STATUSES) & F.col("predicted").isin(STATUSES))
    m = known.groupBy("model").agg(
        F.round(F.try_divide(hit["insufficient_evidence"], of["insufficient_evidence"]), 6).alias("insufficient_recall"),
        F.round(F.try_divide(said["supported"] - hit["supported"], said["supported"]), 6).alias("false_support_rate"),
        F.round(F.try_divide(hit["contradicted"], of["contradicted"]), 6).alias("contradicted_recall"),
        *[x.alias(f"f1_{i}") for i, x in enumerate(f1.values())],
    )
    f = [F.col(f"f1_{i}") for i in range(3)]
    # classes without an F1 do not count; an F1 of two undefined parts is none
    macro = F.round(F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in f[1:]), F.coalesce(f[0], F.lit(0.0))), sum((x.isNotNull().cast("int") for x in f[1:]), f[0].isNotNull().cast("int"))), 6)
    lat = table(spark, sf, "reaudit_outputs").groupBy("model").agg(F.round(F.avg("latency_ms"), 6).alias("latency"))
    m = lat.join(m.select("model", "insufficient_recall", "false_support_rate", "contradicted_recall", macro.alias("macro_f1")), "model", "left")
    order = [F.desc(F.coalesce("insufficient_recall", F.lit(-1.0))), F.asc(F.coalesce("false_support_rate", F.lit(1.0))), F.desc(F.coalesce("contradicted_recall", F.lit(-1.0))), F.desc(F.coalesce("macro_f1", F.lit(-1.0))), F.asc_nulls_last("latency"), F.asc("model")]
    return m.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row per model


def paired_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Answer lengths of the two arms of a question."""
    a = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"])
    long = a.groupBy("stage7_id", F.when(F.col("route") == "hybrid_baseline", "base").otherwise("graph").alias("condition")).agg(F.max(F.length("answer")).cast("double").alias("v"))
    return metrics.paired_difference(long, "stage7_id", "condition", "v", "graph", "base")


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean uncertainty score above 0.5 over all 10 000 resamples, question types weighing the same."""
    p = table(spark, sf, "graph_claim_pilot_manifest").select("pilot_id", F.coalesce("question_type", F.lit("none")).alias("question_type"), (F.col("retrieval_uncertainty_score") - 0.5).alias("d"))
    return bootstrap.interval(bootstrap.poisson_means(p, "pilot_id", "d", stratum="question_type"))


def three_way_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Answer lengths of a question under each disposition, side by side."""
    a = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"])
    c = F.when(F.col("final_disposition") == "abstain", "abstained").when(F.col("route") == "hybrid_baseline", "base").otherwise("graph")
    return metrics.pivot_values(a.select("stage7_id", c.alias("condition"), F.length("answer").alias("v")), "stage7_id", "condition", "v", ["base", "graph", "abstained"])


def largest_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The six pairs whose answers differ most in length."""
    return metrics.largest_differences(table(spark, sf, "paired_answers").dropDuplicates(["pair_id"]), "pair_id", F.length("hybrid_answer"), F.length("bge_answer"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of released arms, and of those without evidence, per question type."""
    a = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"])
    return metrics.rates(a, {"released": F.lower(F.trim("final_disposition")) == "release", "bare": F.coalesce(F.size("evidence_snippet_ids"), F.lit(0)) == 0}, ["question_type"])


def mean_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean number of evidence ids per route."""
    return metrics.mean_size(table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"]), "evidence_snippet_ids", ["route"])


def distinct_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims by question and text without case and outer blanks."""
    c = table(spark, sf, "reaudit_outputs").select("question_id", F.explode("claims").alias("c"))
    return metrics.distinct_combinations(c, [F.col("question_id").alias("q"), F.lower(F.trim("c.text")).alias("t")])


def released_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    """Records not deleted, and those among them with a verdict that is not supported."""
    v = _checks(spark, sf).withColumn("status", F.lower(F.trim("status")))
    return evidence.released_with_unsupported(table(spark, sf, "reaudit_outputs"), v, "record_id", F.col("deleted_at").isNull(), "status", "supported")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose reply and claims are complete, and whose verdicts name exactly their claims."""
    key = lambda v, c: F.concat_ws("/", v, c)
    given = table(spark, sf, "claim_verifications").where("claim_id is not null").select("record_id", key(F.col("variant"), F.col("claim_id")).alias("k")).distinct().groupBy("record_id").agg(F.count(F.lit(1)).alias("n_given"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("sum_given"))
    r = table(spark, sf, "reaudit_outputs")
    k = F.array_distinct(F.transform("claims", lambda c: key(c["variant"], c["claim_id"])))
    r = r.select("record_id", evidence.answer_complete(F.col("claims"), F.col("raw_response")).alias("answer"), F.size(k).alias("n_wanted"), F.aggregate(F.transform(k, lambda x: F.xxhash64(x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)")).alias("sum_wanted"))
    j = r.join(given, "record_id", "left")
    verified = F.coalesce((F.col("n_wanted") == F.col("n_given")) & (F.col("sum_wanted") == F.col("sum_given")), F.lit(False))
    return j.groupBy(F.col("answer").alias("answer_complete"), verified.alias("verification_complete")).agg(F.count(F.lit(1)).alias("n"))


def ordered_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T4: pilots in the order high, medium, low, then by falling score and rising id."""
    from pyspark.sql.window import Window

    p = table(spark, sf, "graph_claim_pilot_manifest").withColumn("o", text.enum_order(F.col("retrieval_uncertainty_label"), ["high", "medium", "low"]))
    w = Window.partitionBy("question_type").orderBy("o", F.desc_nulls_last("retrieval_uncertainty_score"), "pilot_id")
    return p.select("question_type", "pilot_id", F.row_number().over(w).alias("place"))


def pilot_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The pilots' questions, in the order of the pilots, looked up in the routed records; which are not there."""
    ids = table(spark, sf, "graph_claim_pilot_manifest").where("question_id is not null").select("pilot_id", "question_id")
    first = table(spark, sf, "graph_routing").where("question_id is not null").groupBy("question_id").agg(F.min("record_id").alias("record_id"))
    return sampling.ordered_lookup(ids, first, "pilot_id", "question_id")


def public_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The pilots as they may be shown: no question id, no score."""
    return sampling.allowed_columns(table(spark, sf, "graph_claim_pilot_manifest"), ["pilot_id", "question_type", "question"])


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """The second answers of the pairs as gold, in the polymorphic form of the source: items with synonyms, or one text."""
    p = table(spark, sf, "paired_answers").dropDuplicates(["pair_id"]).where("hybrid_answer is not null")
    groups = F.to_json(F.transform(F.filter(F.split("hybrid_answer", r"[;\n]"), lambda x: F.trim(x) != ""), lambda x: F.array(F.trim(x))))
    raw = F.when(F.col("question_type").isin("list", "factoid"), groups).otherwise(F.concat(F.lit('"'), F.regexp_replace("hybrid_answer", r'["\\\x00-\x1f]', " "), F.lit('"')))
    return p.select("pair_id", F.parse_json(raw).alias("exact"), F.array("hybrid_answer").alias("ideal"))


def scored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """First answers scored against gold by question type; pairs without gold are kept, with null scores."""
    p = table(spark, sf, "paired_answers").dropDuplicates(["pair_id"]).select("pair_id", "question_type", "bge_answer")
    j = p.join(_gold(spark, sf), "pair_id", "left").withColumn("exact", scoring.gold_for(F.col("question_type"), F.col("exact"))).withColumn("has_gold", F.col("ideal").isNotNull())
    s = scoring.scored(j, "question_type", "bge_answer", "exact", "ideal")
    blank = lambda c: F.when(F.col("has_gold"), F.round(c, 6)).alias(c)
    return s.select("pair_id", "question_type", "has_gold", blank("primary_score"), blank("strict_score"))


def missing_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Results without gold, per question type."""
    p = table(spark, sf, "paired_answers").dropDuplicates(["pair_id"])
    return p.join(_gold(spark, sf).select("pair_id"), "pair_id", "left_anti").groupBy("question_type").agg(F.count(F.lit(1)).alias("n_missing"), F.min("pair_id").alias("first_missing"))


def bootstrap_answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean difference of answer lengths per pair, hybrid less BGE, by the seeded replay of all resamples."""
    p = table(spark, sf, "paired_answers").dropDuplicates(["pair_id"])
    return bootstrap.replay_interval(p.select("pair_id", (F.length("hybrid_answer") - F.length("bge_answer")).alias("d")), "pair_id", "d")


# graphs


def graph_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).select("record_id", F.size("graph.entities").alias("n_entities"), F.size("graph.relations").alias("n_relations"), F.size("graph.aspects").alias("n_aspects"), F.col("graph.over").alias("n_over_caps"))


_SHAPES = {
    "entities": "array<struct<entity_id:string,name:string,type:string>>",
    "relations": "array<struct<edge_id:string,source:string,relation:string,target:string,evidence_snippet_ids:array<string>,question_relevance:string>>",
    "answer_aspects": "array<struct<aspect_id:string,description:string,evidence_snippet_ids:array<string>,question_relevance:string>>",
}


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, candidates, fill, graph): graphs in one clean shape, however stored."""
    df = table(spark, sf, "graph_routing")
    v = df.select("record_id", "hybrid_top5", "selection_trace", flatten.graph_variant().alias("_v")).withColumn("_g", flatten.unwrapped(F.col("_v")))
    lists = {n: flatten.as_list(F.try_variant_get("_g", f"$.{n}", "variant")) for n in _SHAPES}
    none = F.array().cast("array<string>")
    f = flatten.field
    ent = F.transform(lists["entities"], lambda e: F.struct(f(e, "entity_id", "id").alias("entity_id"), f(e, "name", "label").alias("name"), f(e, "type").alias("type")))
    ev = lambda x: F.transform(flatten.as_list(F.try_variant_get(x, "$.evidence_snippet_ids", "variant")), lambda s: F.try_variant_get(s, "$", "string"))
    rel = F.transform(lists["relations"], lambda r: F.struct(f(r, "edge_id").alias("edge_id"), f(r, "source").alias("source"), f(r, "relation").alias("relation"), f(r, "target").alias("target"), ev(r).alias("evidence_snippet_ids"), f(r, "question_relevance").alias("question_relevance")))
    asp = F.transform(lists["answer_aspects"], lambda a: F.struct(f(a, "aspect_id").alias("aspect_id"), f(a, "description").alias("description"), ev(a).alias("evidence_snippet_ids"), f(a, "question_relevance").alias("question_relevance")))
    x = v.select("record_id", "hybrid_top5", "selection_trace", ent.alias("e"), rel.alias("r"), asp.alias("a"))
    used = F.concat(F.flatten(F.transform("r", lambda r: r["evidence_snippet_ids"])), F.flatten(F.transform("a", lambda a: a["evidence_snippet_ids"])))
    top = F.coalesce("hybrid_top5", none)
    cand = F.array_distinct(F.concat(top, F.array_sort(F.filter(used, lambda s: s.isNotNull()))))
    x = x.withColumn("candidates", F.filter(cand, lambda s: s.isNotNull())).withColumn("fill", F.filter(top, lambda s: s.isNotNull()))
    return x.select("record_id", "candidates", "fill", graph.clean_graph(F.col("e"), F.col("r"), F.col("a"), F.col("candidates")).alias("graph"))


def greedy_select_broad(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coverage_selection(_cleaned(spark, sf), "record_id", "broad")


def greedy_select_strict(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coverage_selection(_cleaned(spark, sf), "record_id", "strict")


def selection_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded selection against the ranking it started from."""
    g = table(spark, sf, "graph_routing")
    sel = F.filter(F.transform("selection_trace", lambda t: t["snippet_id"]), lambda s: s.isNotNull())
    top = F.filter("hybrid_top5", lambda s: s.isNotNull())
    return g.select("record_id", *[c.alias(n) for n, c in graph.set_changes(top, sel).items()])


# validation and profile


def validator_checks(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reaudit_outputs")
    return validate.run_checks(r, {
        "record_has_id": F.col("record_id").isNotNull(), "mode_is_known": F.col("response_mode").isin("json", "plain"), "has_claims": F.size("claims") > 0,
        "has_reply": F.col("raw_response").isNotNull(), "deleted_after_arrival": F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("arrived_at")),
        "claim_ids_distinct": F.size(F.array_distinct(F.transform("claims", lambda c: F.concat_ws("/", c["variant"], c["claim_id"])))) == F.size("claims"), "latency_positive": F.col("latency_ms") > 0,
    })


def environment(spark: SparkSession, sf: str) -> DataFrame:
    return environment_profile(spark)


QUERIES = {f.__name__: f for f in (
    corpus_dedup, snippet_documents, corpus_rejects, duplicate_groups, duplicate_members, duplicate_report, blinded_key, human_reference, job_arms, request_items, three_way_pivot, largest_differences, coverage, mean_evidence, distinct_claims,
    released_unsupported, completeness, ordered_labels, pilot_lookup, public_questions, scored_answers, missing_gold, duplicate_occurrences, missing_fields, corpus_describe, counts_two_level, gold_relevance_map, dangling_references, content_hash_documents,
    risk_features, graph_lexicon_score, uncertainty_buckets, stratified_sample, pool_cascade, quota_cells, smoke_combination, greedy_grouped_split, hashed_grouped_split, split_overlap_counts,
    split_leakage, pilot_antijoin, evidence_packets, claim_status_counts, raw_reply_claims, claims_renumbered, issue_lists, answer_token_f1, yes_no_answers, rouge_l_pairs, list_f1_pairs,
    factoid_reciprocal_rank, macro_token_f1, confusion_matrix, class_scores, averaged_f1, annotator_agreement, merged_annotations, blinded_packet, job_dedup, batch_plan, arm_fanout,
    checkpoint_last_wins, resume_antijoin, request_groups, token_usage_totals, latency_describe, config_ranking, paired_pivot, bootstrap_interval, bootstrap_answer_scores, graph_normalised, greedy_select_broad,
    greedy_select_strict, selection_counterfactual, validator_checks, environment,
)}
