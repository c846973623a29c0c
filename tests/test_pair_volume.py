"""Retrieval where every question shares a word with every snippet: no row for each pair, results as the SQL's."""

import os

import pytest
from pyspark.sql import functions as F

from lucerna.plans import registry

duckdb = pytest.importorskip("duckdb")
N_QUESTIONS, N_SNIPPETS = 300, 2000
NAMES = [
    "bm25_topk",
    "method_overlap",
    "retrieval_quality",
    "rrf_fusion",
    "cheapest_best_method",
    "rank_shift_flags",
    "retrieval_rescue",
    "uncertainty",
]


@pytest.fixture(scope="module")
def hot_sf(spark, sf, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("hot"))

    def repeated(name, n):
        t = spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1)
        return t.crossJoin(F.broadcast(spark.range(-(-n // t.count())).withColumnRenamed("id", "copy"))).limit(n).withColumn("nr", F.monotonically_increasing_id())

    q = repeated("graph_routing", N_QUESTIONS)
    q.withColumn("record_id", (F.col("nr") * 50).cast(q.schema["record_id"].dataType)).withColumn("question", F.concat(F.lit("the "), "question")).drop("nr", "copy").write.parquet(f"{where}/graph_routing.parquet")
    s = repeated("candidate_snippets", N_SNIPPETS)
    s.withColumn("snippet_id", F.when(F.col("copy") == 0, F.col("snippet_id")).otherwise(F.concat("snippet_id", F.lit("-"), "copy"))).withColumn("text", F.concat(F.lit("the "), "text")).drop("nr", "copy").write.parquet(f"{where}/candidate_snippets.parquet")
    return where


def shuffled(spark, job):
    """The rows that a job writes for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    last = max(stages(), default=-1)
    job()
    return sum(n for k, n in stages().items() if k > last)


@pytest.mark.parametrize("name", NAMES)
def test_pairs_never_become_rows(spark, hot_sf, name):
    got = []
    moved = shuffled(spark, lambda: got.append(registry.queries()[name](spark, hot_sf).toPandas()))
    assert moved < N_QUESTIONS * N_SNIPPETS / 5
    c = duckdb.connect()
    for t in os.listdir(hot_sf):
        c.execute(f"create view {t[:-8]} as select * from '{hot_sf}/{t}/*.parquet'")
    r = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]

    def plain(rows):
        return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in x) for x in rows), key=repr)

    assert plain(got[0][names].itertuples(index=False, name=None)) == plain(r.fetchall())
