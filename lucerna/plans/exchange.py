"""Queries through the sources, sinks, services and small functions: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import annotate, dense, evidence, graph, jobs, validate
from ..services import model_client, prompts
from ..session import stamped, table
from ..sources import readers, sinks
from ..streaming import pipelines
from ..workspace import Workspace


def _place(spark: SparkSession, name: str) -> str:
    return f"{Workspace(spark, 'exchange').path}/{name}"


def json_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K1/S2."""
    p = table(spark, sf, "paired_answers").select("pair_id", "question", "bge_answer")
    ws = Workspace(spark, "exchange")
    sinks.write_json_lines(p, f"{ws.path}/lines", ["pair_id"])
    # parsed once: a scan of JSON cannot be asked for its broken lines alone
    back = ws.keep(readers.read_json_lines(spark, f"{ws.path}/lines", "pair_id bigint, question string, bge_answer string"), "parsed")
    return back.where("_corrupt_record is null").drop("_corrupt_record")


def json_object_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K2: a summary as one object."""
    where = _place(spark, "object")
    sinks.write_json_object(table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_chars").alias("longest")), where)
    return spark.read.schema("n_documents bigint, longest bigint").json(where, multiLine=True)


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """List cells as JSON, texts with quotes and line breaks."""
    a = table(spark, sf, "evidence_arms").distinct()
    where = _place(spark, "csv")
    sinks.write_csv(a, where, ["arm_row_id", "evidence_snippet_ids", "question"], ["arm_row_id"])
    c = readers.read_csv(spark, where)
    return c.select(F.col("arm_row_id").cast("long").alias("arm_row_id"), F.size(F.from_json("evidence_snippet_ids", "array<string>")).alias("n_ids"), "question")


def id_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K5/S4."""
    where = _place(spark, "ids")
    sinks.write_id_list(table(spark, sf, "graph_claim_pilot_manifest").select("question_id").distinct(), where, "question_id")
    return readers.read_id_list(spark, where, "question_id")


def question_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-file JSON with polymorphic answers; files of about a thousand questions each."""
    p = table(spark, sf, "paired_answers").select("pair_id", "question", "question_type", "bge_answer")
    answer = F.when(F.col("question_type") == "list", F.to_json(F.array("bge_answer"))).otherwise(F.to_json(F.struct(F.col("bge_answer").alias("v"))))
    answer = F.when(F.col("bge_answer").isNull(), "null").when(F.col("question_type") == "list", answer).otherwise(F.regexp_extract(answer, r"(?s)^\{\"v\":(.*)\}$", 1))
    q = F.to_json(F.struct(F.col("pair_id").cast("string").alias("id"), F.col("question").alias("body"), F.col("question_type").alias("type")))
    q = F.concat(F.expr("substring(q, 1, length(q) - 1)"), F.lit(', "exact_answer": '), F.col("a"), F.lit("}"))
    rows = p.select(F.floor(F.col("pair_id") / 1000).alias("file"), F.to_json(F.struct(F.col("pair_id").cast("string").alias("id"), F.col("question").alias("body"), F.col("question_type").alias("type"))).alias("q"), answer.alias("a"))
    docs = rows.select("file", q.alias("q")).groupBy("file").agg(F.concat(F.lit('{"questions": ['), F.array_join(F.collect_list("q"), ", "), F.lit("]}")).alias("value"))
    where = _place(spark, "questions")
    docs.select("value").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "value").write.option("maxRecordsPerFile", 1).text(where)
    return readers.read_questions(spark, where).select(F.col("id").cast("long").alias("pair_id"), "type", readers.answer_shape(F.col("exact_answer")).alias("shape"))


def vector_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K7/S5."""
    where = _place(spark, "vectors")
    sinks.append_checkpoint(table(spark, sf, "embeddings").select("vec_id", "embedding"), where)
    v = readers.read_vectors(spark, where, "vec_id")
    return v.select("vec_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def checkpoint_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A log of two appends; the latest record of each key that holds."""
    v = table(spark, sf, "claim_verifications").where("claim_id is not null").select(F.concat_ws("/", F.col("record_id").cast("string"), "variant", "claim_id").alias("k"), "checked_at", "verification_id", "status")
    where = _place(spark, "log")
    half = F.lit("2025-07-01").cast("timestamp_ntz")
    sinks.append_checkpoint(v.where(F.col("checked_at") >= half), where)
    sinks.append_checkpoint(v.where(~(F.col("checked_at") >= half)), where)
    return readers.read_checkpoint(spark, where, "k", ["checked_at", "verification_id"], F.col("status").isNotNull()).select("k", "verification_id", "status")


def cache_append(spark: SparkSession, sf: str) -> DataFrame:
    """K9: the second append adds only what the first did not hold."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    where = _place(spark, "cache")
    counts = [sinks.append_missing(e.where("label is not null and label < 3"), where, "vec_id"), sinks.append_missing(e, where, "vec_id"), sinks.append_missing(e, where, "vec_id")]
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(counts)], "step int, n_added bigint")


def fetched_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file copied under its published sum, again, and under a wrong one."""
    source, target = f"{sf}/split_targets.parquet", _place(spark, "split_targets.parquet")
    if not _is_file(spark, source):  # a table of several files: its first
        source = spark.read.format("binaryFile").load(source).orderBy("path").first()["path"]
    md5, said = readers.checksums(spark, source).first()["md5"], []
    for wanted in (md5, md5, "0" * 32):
        try:
            said.append(("kept" if readers.fetch(spark, source, target, wanted) == target else "?"))
        except ValueError:
            said.append("quarantined")
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(said)], "step int, outcome string")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def found_file(spark: SparkSession, sf: str) -> DataFrame:
    """The first place of a list that exists."""
    where = readers.find_file(spark, [f"{sf}/no-such-table.parquet", f"{sf}/documents.parquet"])
    return spark.createDataFrame([(where.rsplit("/", 1)[-1],)], "file string")


def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three tables; their hash is independent of files and order."""
    m = sinks.manifest({n: table(spark, sf, n) for n in ("candidate_snippets", "documents", "paired_answers")})
    again = sinks.manifest({n: table(spark, sf, n).repartition(3) for n in ("candidate_snippets", "documents", "paired_answers")})
    return m.join(again.select("table", F.col("content_hash").alias("h")), "table").select("table", "n_rows", (F.col("content_hash") == F.col("h")).alias("same"))


def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    """F20."""
    b = table(spark, sf, "body_records").where("ids is not null and source is not null")
    return b.select("record_id", F.md5(text.canonical_json({"source": F.col("source"), "ids": F.col("ids")})).alias("digest"))


def retry_waits(spark: SparkSession, sf: str) -> DataFrame:
    """the waits that messages built from the latencies ask for."""
    r = table(spark, sf, "reaudit_outputs").where("latency_ms is not null").select("record_id", F.floor("latency_ms").alias("ms"))
    return r.select("record_id", F.round(text.retry_seconds(F.concat(F.lit("Rate limit reached, please try again in "), "ms", F.lit("ms."))), 6).alias("seconds"))


def edge_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F24 over the cleaned graphs."""
    from .evaluation import _cleaned

    return _cleaned(spark, sf).select("record_id", F.md5(text.edges_text(F.col("graph.relations"))).alias("edges_md5"))


def output_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """room for a reply by the number of claims."""
    n = F.coalesce(F.size("claims"), F.lit(0))
    return table(spark, sf, "reaudit_outputs").select("record_id", text.output_budget(n, 900, 320, 3400).alias("budget"))


def first_filled(spark: SparkSession, sf: str) -> DataFrame:
    """P25: the first of three columns that is not blank."""
    return table(spark, sf, "documents").select("doc_id", annotate.first_filled(F.col("journal"), F.col("source"), F.col("lang")).alias("label"))


def required_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Reading a row without an id would raise."""
    return validate.require(table(spark, sf, "body_records"), F.col("record_id").isNotNull(), "a record has no id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def strict_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Arms with exactly five different ids, all of them in the bank."""
    bank = table(spark, sf, "candidate_snippets")
    arms = table(spark, sf, "evidence_arms").dropDuplicates(["arm_row_id"]).where(F.size(F.array_distinct("evidence_snippet_ids")) == 5).where(F.size("evidence_snippet_ids") == 5)
    lost = arms.select("arm_row_id", F.explode("evidence_snippet_ids").alias("snippet_id")).join(bank.select("snippet_id").distinct(), "snippet_id", "left_anti").select("arm_row_id").distinct()
    known = arms.join(lost, "arm_row_id", "left_anti")
    return evidence.strict_evidence(known, "arm_row_id", "evidence_snippet_ids", bank, "snippet_id", "text").select("arm_row_id", "evidence_id", "snippet_id")


def reused_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose vector the cache holds, and those to compute."""
    r = jobs.reuse(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), table(spark, sf, "embeddings"), "vec_id", "label")
    return r.groupBy("must_compute").agg(F.count(F.lit(1)).alias("n"))


def same_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table against itself in another order, and against itself without repeats."""
    a = table(spark, sf, "evidence_arms").select("arm_row_id", "route")
    return spark.createDataFrame([(validate.same_rows(a, a.repartition(5)), validate.same_rows(a, a.distinct()))], "with_itself boolean, without_repeats boolean")


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The selection as a ranking of the stored candidates."""
    sel = F.filter(F.transform("selection_trace", lambda t: t["snippet_id"]), lambda s: s.isNotNull())
    top = F.filter("hybrid_top5", lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    return table(spark, sf, "graph_routing").select("record_id", F.array_join(graph.merged_rerank(F.coalesce(sel, none), F.coalesce(top, none)), ",").alias("ranking"))


def adversarial_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Second answers that are not blank and differ from the first, numbered."""
    p = table(spark, sf, "paired_answers").dropDuplicates(["pair_id"]).select("pair_id", "bge_answer", "hybrid_answer")
    return annotate.adversarial_candidates(p, "pair_id", "hybrid_answer", "bge_answer").select("candidate_id", "pair_id")


def model_choice(spark: SparkSession, sf: str) -> DataFrame:
    """From the models that ran, the first preferred one that is not excluded."""
    return model_client.choose_model(table(spark, sf, "evidence_arms").select("model").distinct(), "model", ["no-such-model", "corvo-70b", "aster-32b"], ["mini"])


def verifier_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The verifier's prompt of every record."""
    r = table(spark, sf, "reaudit_outputs")
    lines = lambda a, f: F.array_join(F.transform(a, f), "\n")
    ev = lines("evidence", lambda e: F.concat(F.lit("["), F.coalesce(e["evidence_id"], F.lit("")), F.lit("] "), F.coalesce(e["snippet_id"], F.lit(""))))
    cl = lines("claims", lambda c: F.concat(F.coalesce(c["claim_id"], F.lit("")), F.lit(": "), F.coalesce(c["text"], F.lit(""))))
    return r.select("record_id", F.md5(prompts.prompt("verifier", question=F.col("question"), evidence=ev, claims=cl)).alias("prompt_md5"))


def offline_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A structured call for every pilot question by the offline client."""
    p = table(spark, sf, "graph_claim_pilot_manifest").select("pilot_id", "question")
    calls = model_client.run_jobs(p, "pilot_id", "question", model_client.OfflineClient)
    return calls.select("pilot_id", "attempt", "response_mode", "json_repaired", "waits", F.get_json_object("raw_response", "$.answer").alias("answer"))


def latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The latest verdict per record as a running aggregate over a stream of files, read to its end."""
    base = Workspace(spark, "stream").path
    v = table(spark, sf, "claim_verifications").select("record_id", "verification_id", "checked_at", "status").where("checked_at is not null")
    v.repartition(3, "verification_id").write.parquet(f"{base}/in")
    s = pipelines.file_stream(spark, f"{base}/in", "record_id bigint, verification_id bigint, checked_at timestamp_ntz, status string")
    latest = pipelines.latest_per_key(s.withColumn("o", F.struct("checked_at", "verification_id")), "record_id", "o", ["verification_id"])
    out = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")
    latest.writeStream.outputMode("complete").foreachBatch(out).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the bank's snippets by the offline embedder; those of a first half are taken from a cache."""
    bank = table(spark, sf, "candidate_snippets").where("snippet_id is not null").groupBy("snippet_id").agg(F.min("text").alias("text"))
    where = _place(spark, "embedded")
    model = dense.HashingEmbedder()
    sinks.append_checkpoint(dense.embed(bank.where(F.pmod(F.xxhash64("snippet_id"), F.lit(2)) == 0), "snippet_id", "text", model), where)
    sinks.append_checkpoint(dense.embed(dense.missing_embeddings(bank, spark.read.parquet(where), "snippet_id"), "snippet_id", "text", model), where)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return readers.read_vectors(spark, where, "snippet_id").select("snippet_id", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


def run_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """one time for all rows of a run."""
    return stamped(table(spark, sf, "container_sizes")).agg(F.count("run_at").alias("n"), F.count_distinct("run_at").alias("n_times"))


QUERIES = {f.__name__: f for f in (
    json_lines_roundtrip, json_object_roundtrip, csv_roundtrip, id_list_roundtrip, question_files, vector_roundtrip, checkpoint_roundtrip, cache_append, fetched_files, found_file, table_manifest, canonical_records, retry_waits,
    edge_texts, output_budgets, first_filled, required_rows, strict_evidence, reused_vectors, same_rows, reranked, adversarial_candidates, model_choice, verifier_prompts, offline_calls, latest_stream, hashed_embeddings, run_stamp,
)}


def _sql_template(template: str, columns: dict[str, str]) -> str:
    """A template as an SQL expression."""
    out = "'" + template.replace("'", "''") + "'"
    for name, column in columns.items():
        out = out.replace("{" + name + "}", f"' || coalesce({column}, '') || '")
    return out


ORACLE = {
    "json_lines_roundtrip": "SELECT pair_id, question, bge_answer FROM paired_answers",
    "json_object_roundtrip": "SELECT count(*) AS n_documents, max(n_chars) AS longest FROM documents",
    "csv_roundtrip": "SELECT arm_row_id, len(evidence_snippet_ids)::INT AS n_ids, question FROM (SELECT DISTINCT * FROM evidence_arms)",
    "id_list_roundtrip": "SELECT DISTINCT trim(question_id) AS question_id FROM graph_claim_pilot_manifest WHERE question_id IS NOT NULL",
    "question_files": "SELECT pair_id, lower(trim(coalesce(question_type, 'missing'))) AS type, CASE WHEN bge_answer IS NULL THEN 'missing' WHEN question_type = 'list' THEN 'list' ELSE 'string' END AS shape FROM paired_answers",
    "vector_roundtrip": "SELECT vec_id, len(embedding)::INT AS dimension, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "checkpoint_roundtrip": "SELECT k, verification_id, status FROM (SELECT record_id || '/' || variant || '/' || claim_id k, verification_id, status, row_number() OVER (PARTITION BY record_id, variant, claim_id ORDER BY checked_at DESC, verification_id DESC) r FROM claim_verifications WHERE claim_id IS NOT NULL) WHERE r = 1 AND status IS NOT NULL",
    "cache_append": "SELECT 1 AS step, count(*) FILTER (WHERE label < 3) AS n_added FROM embeddings UNION ALL SELECT 2, count(*) FILTER (WHERE NOT coalesce(label < 3, false)) FROM embeddings UNION ALL SELECT 3, 0",
    "fetched_files": "SELECT * FROM (VALUES (1, 'kept'), (2, 'kept'), (3, 'quarantined')) t(step, outcome)",
    "found_file": "SELECT 'documents.parquet' AS file",
    "table_manifest": "SELECT 'candidate_snippets' AS \"table\", count(*) AS n_rows, true AS same FROM candidate_snippets UNION ALL SELECT 'documents', count(*), true FROM documents UNION ALL SELECT 'paired_answers', count(*), true FROM paired_answers",
    "canonical_records": """SELECT record_id, md5('{"ids": ' || replace(to_json(ids)::VARCHAR, '","', '", "') || ', "source": ' || to_json(source)::VARCHAR || '}') AS digest FROM body_records WHERE ids IS NOT NULL AND source IS NOT NULL""",
    "retry_waits": "SELECT record_id, round(floor(latency_ms) * 0.001::DOUBLE, 6) AS seconds FROM reaudit_outputs WHERE latency_ms IS NOT NULL",
    "output_budgets": "SELECT record_id, least(3400, greatest(0, 900 + 320 * coalesce(len(claims), 0)))::INT AS budget FROM reaudit_outputs",
    "first_filled": "SELECT doc_id, coalesce(nullif(trim(journal), ''), nullif(trim(source), ''), nullif(trim(lang), '')) AS label FROM documents",
    "required_rows": "SELECT split, count(*) AS n FROM body_records GROUP BY 1",
    "strict_evidence": """WITH a AS (SELECT DISTINCT arm_row_id, evidence_snippet_ids l FROM evidence_arms WHERE len(list_distinct(evidence_snippet_ids)) = 5 AND len(evidence_snippet_ids) = 5),
x AS (SELECT arm_row_id, unnest(l) s, unnest(range(1, 6)) p FROM a), bad AS (SELECT DISTINCT arm_row_id FROM x WHERE s IS NULL OR s NOT IN (SELECT snippet_id FROM candidate_snippets WHERE snippet_id IS NOT NULL))
SELECT arm_row_id, 'E' || p AS evidence_id, s AS snippet_id FROM x WHERE arm_row_id NOT IN (SELECT arm_row_id FROM bad)""",
    "reused_vectors": "SELECT label IS NULL AS must_compute, count(*) AS n FROM documents LEFT JOIN (SELECT vec_id, min(label) label FROM embeddings GROUP BY 1) e ON e.vec_id = doc_id GROUP BY 1",
    "same_rows": "SELECT true AS with_itself, (SELECT count(*) FROM evidence_arms) = (SELECT count(*) FROM (SELECT DISTINCT arm_row_id, route FROM evidence_arms)) AS without_repeats",
    "reranked": """WITH x AS (SELECT record_id, list_filter(coalesce(hybrid_top5, []::VARCHAR[]), lambda s: s IS NOT NULL) c, list_filter(coalesce(list_transform(selection_trace, lambda t: t.snippet_id), []::VARCHAR[]), lambda s: s IS NOT NULL) r FROM graph_routing),
y AS (SELECT record_id, list_concat(list_filter(r, lambda s: list_contains(c, s)), c) l FROM x), z AS (SELECT record_id, s, min(p) p FROM (SELECT record_id, unnest(l) s, unnest(range(len(l))) p FROM y) GROUP BY 1, 2)
SELECT record_id, coalesce(string_agg(s, ',' ORDER BY p), '') AS ranking FROM x LEFT JOIN z USING (record_id) GROUP BY 1""",
    "adversarial_candidates": "SELECT 'ADV-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS candidate_id, pair_id FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) n FROM (SELECT DISTINCT pair_id, bge_answer b, hybrid_answer h FROM paired_answers) WHERE trim(coalesce(h, ''), ' ') <> '' AND NOT coalesce(lower(h) = lower(b), false))",
    "model_choice": "WITH m AS (SELECT DISTINCT model FROM evidence_arms WHERE model IS NOT NULL AND NOT contains(lower(model), 'mini')) SELECT arg_min(model, (CASE model WHEN 'no-such-model' THEN 1 WHEN 'corvo-70b' THEN 2 WHEN 'aster-32b' THEN 3 ELSE 4 END, model)) AS model, count(*) AS n_eligible FROM m",
    "verifier_prompts": "WITH x AS (SELECT record_id, question, array_to_string(list_transform(evidence, lambda e: '[' || coalesce(e.evidence_id, '') || '] ' || coalesce(e.snippet_id, '')), chr(10)) ev, array_to_string(list_transform(claims, lambda c: coalesce(c.claim_id, '') || ': ' || coalesce(c.text, '')), chr(10)) cl FROM reaudit_outputs) SELECT record_id, md5("
    + _sql_template(prompts.VERIFIER, {"question": "question", "evidence": "ev", "claims": "cl"})
    + ") AS prompt_md5 FROM x",
    "offline_calls": "SELECT pilot_id, 1 AS attempt, 'json' AS response_mode, false AS json_repaired, 0 AS waits, sha256(coalesce(question, ''))[1:12] AS answer FROM graph_claim_pilot_manifest",
    "latest_stream": "SELECT record_id, arg_max(verification_id, (checked_at, verification_id)) AS verification_id FROM claim_verifications WHERE checked_at IS NOT NULL GROUP BY 1",
    "hashed_embeddings": "SELECT snippet_id, 64 AS dimension, 1.0::DOUBLE AS norm FROM (SELECT snippet_id, min(text) t FROM candidate_snippets WHERE snippet_id IS NOT NULL GROUP BY 1) WHERE t IS NOT NULL",
    "run_stamp": "SELECT count(*) AS n, 1 AS n_times FROM container_sizes",
}
