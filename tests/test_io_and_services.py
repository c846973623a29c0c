"""Sources, sinks, the model client and the streaming pipelines."""

import json

import pytest
from pyspark.sql import functions as F

from lucerna.services import model_client as M
from lucerna.sources import readers, sinks
from lucerna.streaming import pipelines


def test_questions(spark, tmp_path):
    q = [{"id": "1", "body": "b", "type": " List ", "exact_answer": [["a", "b"]]}, {"id": "2", "exact_answer": "yes"}, {"id": "3", "exact_answer": ["x"]}, {"id": "4"}]
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"questions": q}, indent=1))
    df = readers.read_questions(spark, str(p))
    got = df.select("id", "type", readers.answer_shape(F.col("exact_answer")).alias("s")).orderBy("id").collect()
    assert [(r.id, r.type, r.s) for r in got] == [("1", "list", "list_of_lists"), ("2", "missing", "string"), ("3", "missing", "list"), ("4", "missing", "missing")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(2, "é, \"q\"\nx", ["a"]), (1, None, [])], "n int, s string, l array<string>")
    sinks.write_json_lines(df, str(tmp_path / "j"), ["n"])
    back = readers.read_json_lines(spark, str(tmp_path / "j"), "n int, s string, l array<string>")
    assert [(r.n, r.s) for r in back.orderBy("n").collect()] == [(1, None), (2, 'é, "q"\nx')] and all(r._corrupt_record is None for r in back.collect())
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "s", "l"], ["n"])
    c = readers.read_csv(spark, str(tmp_path / "c"))
    assert [(r.n, r.l) for r in c.orderBy("n").collect()] == [("1", "[]"), ("2", '["a"]')]
    sinks.write_id_list(df, str(tmp_path / "i"), "n", files=1)
    assert [r.id for r in readers.read_id_list(spark, str(tmp_path / "i")).collect()] == ["1", "2"]
    sinks.write_json_object(df.where("n = 2"), str(tmp_path / "o"))
    assert readers.checksums(spark, str(tmp_path / "i" / "*.txt")).count() == 1
    assert readers.find_file(spark, [str(tmp_path / "nope"), str(tmp_path / "i")]) == str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        readers.find_file(spark, [str(tmp_path / "nope")])
    m = sinks.manifest({"t": df})
    assert m.first().n_rows == 2


def test_checkpoint_log(spark, tmp_path):
    where = str(tmp_path / "log")
    assert readers.read_checkpoint(spark, where, "k", ["n"]).count() == 0
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "bad")], "k string, n int, v string")
    assert sinks.append_missing(a, where, "k") == 2 and sinks.append_missing(a, where, "k") == 0
    sinks.append_checkpoint(spark.createDataFrame([("x", 2, "new")], "k string, n int, v string"), where)
    got = readers.read_checkpoint(spark, where, "k", ["n"], valid="v <> 'bad'")
    assert [(r.k, r.v) for r in got.collect()] == [("x", "new")]


def test_structured_call():
    naps, replies = [], iter(["429, try again in 2s", "nonsense", '{"a": 1', '{"a": 2}'])

    class Client:
        model = "m"

        def complete(self, prompt, mode, budget):
            r = next(replies)
            if r.startswith("429"):
                raise M.ModelError(r)
            return r

    got = M.structured_call(Client(), "p", M.Policy(sleep=naps.append), lambda v: [] if v.get("a") == 2 else ["a must be 2"])
    assert json.loads(got["raw_response"]) == {"a": 2} and got["waits"] == 1 and naps[0] == 7.0 and got["issues"] == [] and not got["json_repaired"]

    class Dead:
        model = "m"

        def complete(self, prompt, mode, budget):
            raise M.ModelError("boom")

    assert M.structured_call(Dead(), "p", M.Policy(sleep=naps.append))["issues"] == ["no_reply"]


def test_run_jobs_and_model_choice(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k bigint, prompt string")
    got = M.run_jobs(units, "k", "prompt", M.OfflineClient, partitions=2).collect()
    assert len(got) == 3 and all(json.loads(r.raw_response)["claims"] for r in got)
    cat = spark.createDataFrame([("z-large",), ("b-guard",), ("a-small",)], "id string")
    assert M.choose_model(cat, "id", ["z-large"], ["guard"]).first().model == "z-large"
    assert M.choose_model(cat, "id", ["none"], ["guard"]).first().model == "a-small"
    assert units.select(M.fill_prompt("Q: {q}!", q=F.col("prompt")).alias("x")).orderBy("x").first().x == "Q: !"


def test_streams_equal_batches(spark, sf, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    e = spark.read.parquet(f"{sf}/events.parquet")
    (e.repartition(3).write.mode("overwrite").parquet(str(src / "all")))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    s = pipelines.file_stream(spark, str(src / "all"), pipelines.EVENTS)
    for _ in range(2):  # the second run is a replay and adds nothing
        pipelines.run_batches(s, lambda d: d.select("event_id", F.lit(1).alias("done")), "event_id", out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == e.select("event_id").distinct().count()
    stream = pipelines.event_stream(spark, str(src / "all"), "*.parquet")
    late = str(tmp_path / "late")
    pipelines.run_batches(stream, lambda d: d.select("event_id"), "event_id", late, str(tmp_path / "ck2"), "ts", "400 days").awaitTermination()
    assert spark.read.parquet(late).count() == e.select("event_id").distinct().count()
    q = pipelines.windowed(stream, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = pipelines.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    q = pipelines.latest_per_key(stream, "user_id", "ts", ["event_id"]).writeStream.format("memory").queryName("l").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("l").count() == e.select("user_id").distinct().count()
    q = pipelines.deduplicated(stream, ["event_id"], "400 days").writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").count() == e.select("event_id").distinct().count()


def test_workspaces_are_swept(spark):
    import os

    from lucerna import workspace as W

    with W.Workspace(spark, "with") as ws:
        ws.keep(spark.range(3).toDF("n"), "a")
        where = ws.path.removeprefix("file:")
        assert os.path.isdir(where)
    assert not os.path.isdir(where)
    ws = W.Workspace(spark, "swept")
    assert ws.route(spark.createDataFrame([(1, "x"), (2, "y")], "n int, k string"), "r", ["k"]).where("k = 'y'").first().n == 2
    assert W.sweep(spark) >= 1 and not os.path.isdir(ws.path.removeprefix("file:"))
    dead = W.shared_dir(spark).removeprefix("file:") + "/lucerna-dead"
    os.makedirs(dead)
    W.sweep_dead(spark, {"dead", spark.sparkContext.applicationId})
    assert not os.path.isdir(dead)


def test_fetch_checks_the_sum(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"abc")
    md5 = hashlib.md5(b"abc").hexdigest()
    assert readers.fetch(spark, str(tmp_path / "a"), str(tmp_path / "b"), md5.upper()) == str(tmp_path / "b") and (tmp_path / "b").read_bytes() == b"abc"
    with pytest.raises(ValueError):
        readers.fetch(spark, str(tmp_path / "a"), str(tmp_path / "c"), "0" * 32)
    assert not (tmp_path / "c").exists() and (tmp_path / "c.quarantine").exists() and not (tmp_path / "c.part").exists()
