"""Operators on small hand-made tables: empty tables, nulls, ties, repeats, clashing names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lucerna.operators import annotate, bootstrap, corpus, dense, evidence, flatten, fusion, graph, jobs, lexical, metrics, orphans, sampling, skew, validate
from lucerna.workspace import Workspace


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_bm25_edges(spark):
    c = spark.createDataFrame([("b", "gene x"), ("a", "gene x"), ("c", None), ("d", ""), ("e", "other")], "d string, t string")
    q = spark.createDataFrame([(1, "gene"), (2, "unknown"), (3, None)], "q int, t string")
    got = lexical.bm25_topk(q, c, "q", "t", "d", "t", 5).orderBy("q", "rank").collect()
    assert [(r.q, r.rank, r.d) for r in got] == [(1, 1, "a"), (1, 2, "b")]
    assert lexical.bm25_topk(q, c.limit(0), "q", "t", "d", "t", 5).count() == 0


def test_bm25_blocks_equal_brute_force(spark):
    """Small blocks, several passes over the queries, frequent terms, repeated texts that tie, null keys of queries."""
    import math
    from collections import Counter

    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = {f"d{i:03}": " ".join(["the"] * r.randint(0, 2) + r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randint(0, 6))) for i in range(300)}
    asked = {(i or None): " ".join(r.sample(["the", *words[:6]], 2) + r.choices(words, k=r.randint(0, 3))) for i in range(30)}
    tf = {d: Counter(t.split()) for d, t in docs.items() if t}
    df, mean = Counter(t for c in tf.values() for t in c), sum(c.total() for c in tf.values()) / len(tf)
    want = []
    for q, text in asked.items():
        score = {}
        for d, c in tf.items():
            for t, n in Counter(text.split()).items():
                if t in c:
                    score[d] = score.get(d, 0) + n * math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        best = sorted((-round(s, 8), d) for d, s in score.items())[:7]
        want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    qs = spark.createDataFrame(list(asked.items()), "q int, t string")
    ds = spark.createDataFrame(list(docs.items()), "d string, t string").coalesce(1)
    for more in ({}, {"block": 20}, {"block": 20, "asked_rows": 25}):
        got = lexical.bm25_topk(qs, ds, "q", "t", "d", "t", 7, **more).select("q", "rank", "d", "score")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), more


def test_hot_term_and_popular_snippet_are_spread(spark):
    """One term, one snippet, one text in all of 25 000 rows."""
    docs = spark.range(25_000).select(F.col("id").alias("d"), F.concat(F.lit("gene u"), "id").alias("t"))
    got = lexical.bm25_topk(spark.createDataFrame([(1, "the gene u123"), (2, "gene")], "q int, t string"), docs, "q", "t", "d", "t", 3)
    assert [(r.q, r.rank, r.d) for r in got.orderBy("q", "rank").collect()] == [(1, 1, 123), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    arms = docs.select("d", F.array(F.lit("hot"), F.concat(F.lit("s"), "d"), F.lit("gone")).alias("ids"))
    bank = docs.select(F.concat(F.lit("s"), "d").alias("s"), "t").unionByName(spark.createDataFrame([("hot", "x")], "s string, t string"))
    p = evidence.evidence_packets(arms, "d", "ids", bank, "s", "t")
    assert p.where("size(packet) = 2 and n_missing = 1 and packet[0].snippet_id = 'hot'").count() == 25_000
    m = corpus.duplicate_members(docs.withColumn("t", F.when(F.col("d") < 22_000, F.lit("Same ")).otherwise(F.col("t"))), "t", "d")
    assert m.count() == 22_000 and m.where("place <= 25").count() == 25
    assert rows(corpus.dangling(arms.select(F.explode("ids").alias("i")), bank, "i", "s")) == [(75_000, 25_000)]


def test_dense_blocks_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(60, 8)), 2).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(99, None)], "k bigint, v array<float>")
    got = rows(dense.dense_topk(df.where("k % 5 = 0"), df, "k", "v", 4, query_block=5, corpus_block=7), "q", "rank", "k")
    assert got == rows(dense.dense_topk(df.where("k % 5 = 0"), df, "k", "v", 4, query_block=5, corpus_block=7, query_bytes=0), "q", "rank", "k")
    want = []
    for q in range(0, 60, 5):
        s = sorted((-round(float(v[q].astype("float64") @ v[i].astype("float64")), 8), i) for i in range(60) if i != q)
        want += [(q, n + 1, i) for n, (_, i) in enumerate(s[:4])]
    assert got == sorted(want)


def test_embedder_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "k bigint, t string")
    e = dense.embed(df, "k", "t", dense.HashingEmbedder(256))
    assert e.count() == 2 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in e.collect())
    assert rows(dense.missing_embeddings(df, e.where("k = 1"), "k"), "k") == [(2,), (3,)]


def test_rrf(spark):
    r = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "x", 2), ("b", 1, "y", 1), ("a", 1, "z", 101)], "method string, q int, item string, rank int")
    got = {r.item: r.score for r in fusion.reciprocal_rank_fusion(r).collect()}
    assert got == {"x": round(1 / 61 + 1 / 62, 8), "y": round(1 / 61, 8)}


def test_place_share_ties_and_single(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "id int, v double")
    assert [(r.id, r.p) for r in fusion.place_share(df, "v", "id", "p").orderBy("p").collect()] == [(1, 0.0), (3, 0.5), (2, 1.0)]
    assert fusion.place_share(df.limit(1), "v", "id", "p").first().p == 0.0
    assert fusion.place_share(df.limit(0), "v", "id", "p").count() == 0


def test_agreement_edge_cases(spark):
    one = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert metrics.agreement(one, "a", "b", ["x", "y"]).first().kappa == 1.0
    none = metrics.agreement(one.limit(0), "a", "b", ["x", "y"]).first()
    assert none.n == 0 and none.kappa is None
    c = {r.label: r for r in metrics.per_class(spark.createDataFrame([("x", "x"), ("y", "x")], "a string, b string"), "a", "b", ["x", "y"]).collect()}
    assert c["y"].precision is None and c["y"].f1 is None and c["x"].precision == 0.5
    assert metrics.averaged_f1(metrics.per_class(spark.createDataFrame([("x", "x"), ("y", "x")], "a string, b string"), "a", "b", ["x", "y"])).first().macro_f1 == pytest.approx(0.666667)


def test_snippet_bank(spark):
    df = spark.createDataFrame([("A  b", ["d2"], 2), (" a B", ["d1", None], 1), ("", ["d3"], 3), (None, None, 4)], "t string, d array<string>, o int")
    got = corpus.snippet_bank(df, "t", "d", "o").collect()
    assert len(got) == 1 and got[0].text == "a B" and got[0].n_documents == 2 and {r.document_id for r in corpus.snippet_documents(df, "t", "d").collect()} == {"d1", "d2"} and got[0].occurrences == 2


def test_missing_fields(spark):
    df = spark.createDataFrame([("", [], None), ("x", ["y"], 1)], "s string, a array<string>, n int")
    assert rows(corpus.missing_fields(df)) == [("a", 1, 2), ("n", 1, 2), ("s", 1, 2)]


# nested records


def brute_items(record_id, g):
    out = set()

    def lst(v):
        return [] if v is None else v if isinstance(v, list) else [v]

    for c, slot, keys, sub in (("entity", "entities", ("entity_id", "id"), None), ("relation", "relations", ("edge_id",), "relation_evidence"), ("aspect", "answer_aspects", ("aspect_id",), "aspect_evidence")):
        for p, x in enumerate(lst(g.get(slot)), 1):
            if x is None:
                continue
            k = next((str(x[k]) for k in keys if isinstance(x, dict) and x.get(k) is not None), "")
            out.add((record_id, c, p, 0, k))
            if sub and isinstance(x, dict):
                out |= {(record_id, sub, p, q, e) for q, e in enumerate(lst(x.get("evidence_snippet_ids")), 1) if e is not None}
    return out


GRAPHS = [
    {"entities": [{"id": "a", "label": "x"}, None, {"name": "y"}], "relations": {"edge_id": "r", "evidence_snippet_ids": "s1"}, "answer_aspects": None},
    {"graph": {"entities": {"entity_id": "e"}, "relations": [{"evidence_snippet_ids": ["s1", None, "s2", "s1"]}], "answer_aspects": [{"aspect_id": 7, "evidence_snippet_ids": []}]}},
    {"entities": []},
    {"entities": ["bare"], "answer_aspects": [{"aspect_id": "", "evidence_snippet_ids": [""]}]},
    {},
]


def test_flatten_variants(spark):
    kind = "struct<entities:array<struct<entity_id:string,name:string,type:string>>,relations:array<struct<edge_id:string,source:string,relation:string,target:string,evidence_snippet_ids:array<string>,question_relevance:string>>,answer_aspects:array<struct<aspect_id:string,description:string,evidence_snippet_ids:array<string>,question_relevance:string>>,graph_sufficient:boolean,route_reason:string>"
    data = [(i, None, json.dumps(g)) for i, g in enumerate(GRAPHS)] + [(90, None, None), (91, None, "{broken"), (92, None, "[]"), (93, None, "3")]
    df = spark.createDataFrame(data, f"record_id bigint, graph {kind}, graph_json string")
    want = set()
    for i, g in enumerate(GRAPHS):
        want |= brute_items(i, g["graph"] if "graph" in g else g)
    items = flatten.routed(df.withColumn("kind", F.lit("clash")), Workspace(spark, "test"))
    got = flatten.supertype(items)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert flatten.graph_roots(df).count() == len(data)
    assert flatten.evidence(items, "relation").count() == sum(1 for x in want if x[1] == "relation_evidence")
    none = flatten.routed(df.limit(0), Workspace(spark, "test"))
    assert flatten.supertype(none).count() == 0 and flatten.of_kind(none, "entity", {"name": ("name",)}).count() == 0


def test_each_variant_has_its_table(spark):
    def one(entities=None, relations=None, aspects=None):
        return json.dumps({"entities": entities, "relations": relations, "answer_aspects": aspects})

    ev = "evidence_snippet_ids"
    data = [
        one([{"entity_id": "e1", "name": "n", "type": "t"}, {"id": "e2", "label": "l"}, {"id": "e3", "name": "n"}, {"type": "t"}, "bare", 7, {"entity_id": {"deep": 1}}, None]),
        one(None, [{"edge_id": "r1", ev: ["s1", None, "s2"]}, {"edge_id": "r2", ev: "s3"}, {"edge_id": "r3", ev: None}, {"edge_id": "r4", ev: [{"x": 1}, "s4"]}, {"edge_id": "r5", "source": ["a"], ev: ["s5"]}]),
        one(aspects={"aspect_id": "a1", ev: []}),
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "record_id bigint, graph_json string").selectExpr("record_id", "cast(null as struct<entities:array<string>>) graph", "graph_json")
    items = flatten.routed(df, Workspace(spark, "test"))
    assert flatten.variants(items) == sorted(
        [("entity", v) for v in ("standard", "alias", "mixed", "nameless", "bare", "other")] + [("relation", v) for v in ("cited", "cited_one", "uncited", "cited_nested", "other")] + [("aspect", "cited")]
    )
    assert rows(flatten.subtype(items, "entity", "alias")) == [(0, 2, "e2", "e2", "l", None)]
    assert rows(flatten.subtype(items, "entity", "other")) == [(0, 6, "", "7"), (0, 7, '{"deep":1}', '{"entity_id":{"deep":1}}')]
    assert flatten.subtype(items, "relation", "cited_one").columns == ["record_id", "item_pos", "item_key", "edge_id", "source", "relation", "target", "question_relevance", "evidence_one"]
    assert rows(flatten.evidence(items, "relation"), "item_pos", "sub_pos", "snippet_id") == [(1, 1, "s1"), (1, 3, "s2"), (2, 1, "s3"), (4, 1, '{"x":1}'), (4, 2, "s4"), (5, 1, "s5")]


def test_relation_links(spark):
    g = {"entities": [{"id": "N1", "label": "p"}, {"id": "N2", "label": "N1"}], "relations": [{"edge_id": "R", "source": "N1", "target": "q"}]}
    df = spark.createDataFrame([(1, json.dumps(g))], "record_id bigint, graph_json string").withColumn("graph", F.lit(None).cast("struct<entities:array<string>>"))
    r = flatten.relation_links(flatten.graph_roots(df)).first()
    assert (r.source_pos, r.target_pos) == (1, None)


# orphans


def test_orphans_in_time_equal_brute_force(spark):
    import datetime as dt

    rnd = random.Random(4)
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    targets = [(rnd.choice("abcd"), day(s := rnd.randrange(300)), None if rnd.random() < 0.2 else day(s + rnd.randrange(-5, 60))) for _ in range(60)] + [("z", None, None), (None, day(1), None)]
    refs = [(i, rnd.choice(["a", "b", "c", "d", "nope", "z"]), day(rnd.randrange(365))) for i in range(300)] + [(900, None, day(1)), (901, "a", None), (902, "nope", None)]
    t = spark.createDataFrame(targets, "k string, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame(refs, "id bigint, ref string, at timestamp_ntz")

    def reason(k, at):
        mine = [x for x in targets if x[0] == k and k is not None]
        if not mine:
            return "missing"
        if at is None or any(s is not None and s <= at and (e is None or at < e) for _, s, e in mine):
            return None
        starts = [s for _, s, _ in mine if s is not None]
        return "late" if starts and at < min(starts) else "deleted"

    want = {i: reason(k, at) for i, k, at in refs}
    for inline in (64, 1):  # the second makes the many-lifetimes path run
        got = orphans.resolve_in_time(r, "ref", "at", t, "k", "s", "e", "id", ["id"], inline=inline)
        assert {x.id: x.reason for x in got.collect()} == want
    assert orphans.resolve_in_time(r.limit(0), "ref", "at", t, "k", "s", "e", "id", ["id"]).count() == 0
    assert {x.reason for x in orphans.resolve_in_time(r, "ref", "at", t.limit(0), "k", "s", "e", "id", ["id"]).collect()} == {"missing"}


@pytest.mark.parametrize("match,want", [("simple", [(2,)]), ("full", [(2,), (3,), (5,)]), ("partial", [(2,), (5,)])])
def test_composite_match(spark, match, want):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "no"), (3, "a", None), (4, None, None), (5, None, "no"), (1, "a", "x")], "id int, p string, q string")
    targets = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "p string, q string")
    assert rows(orphans.composite_orphans(refs, targets, ["p", "q"], match), "id") == want
    assert orphans.composite_orphans(refs.limit(0), targets, ["p", "q"], match).count() == 0


def test_salted_join_equals_plain(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(7, "hot"), (1600, "cold")], "k bigint, v string")
    heavy = skew.heavy_keys(left, "k", least=100)
    assert heavy == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = skew.salted_join(left, right, ["k"], how, heavy, F.col("id")), left.join(right, ["k"], how)
        assert validate.same_rows(a.select(*b.columns), b)


# sampling, jobs, graphs


def test_greedy_split_keeps_groups_and_pins(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(r.choice("st"), f"g{r.randrange(40)}", i % 37 == 0) for i in range(400)], "s string, g string, pin boolean")
    got = sampling.greedy_split(df, "s", "g", 1, pinned="pin")
    assert got.count() == df.select("s", "g").distinct().count()
    n = {x.split: x.n for x in df.join(got, ["s", "g"]).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(n["train"] / 400 - 0.7) < 0.1 or sum(n.values()) == 400
    pinned = df.where("pin").select("s", "g").distinct().join(got, ["s", "g"])
    assert {x.split for x in pinned.collect()} == {"dev"}


def test_batches_and_last_written(spark):
    j = spark.range(14).select(F.col("id").alias("o"))
    b = jobs.batch_plan(j, "o").orderBy("job_order").collect()
    assert [x.batch_index for x in b] == [1] * 6 + [2] * 6 + [3] * 2 and [x.o for x in b] == list(range(14))
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(((x.k, x.v) for x in jobs.last_written(log, "k", ["n"]).collect())) == [("a", "y"), ("b", None)]
    assert rows(jobs.remaining(log, spark.createDataFrame([("a",)], "k string"), "k"), "k") == [("b",)]


def test_selector_rules():
    items = [("r0", "relation", "high", ["c"]), ("a0", "aspect", "low", ["d"])]
    strict = graph.select_by_coverage(["a", "b", "c", "d", "e", "f"], items, "strict", 5, ["a", "b", "d"])
    assert [t[1] for t in strict] == ["c", "a", "b", "d", "e"] and strict[0][3] == "coverage" and strict[1][3] == "fill"
    broad = graph.select_by_coverage(["a", "b", "c", "d", "e", "f"], items, "broad", 5, ["a", "b", "d"])
    assert len(broad) == 5 and broad[0][1] == "c" and all(t[3] == "coverage" for t in broad)
    assert graph.select_by_coverage([], items, "strict") == []


def test_packets_and_claims(spark):
    df = spark.createDataFrame([(1, ["x", "gone", None, "x", "y"]), (2, []), (3, None)], "k int, ids array<string>")
    c = spark.createDataFrame([("x", "tx"), ("y", None), ("x", "tx2")], "sid string, text string")
    got = {r.k: r for r in evidence.evidence_packets(df, "k", "ids", c, "sid", "text").collect()}
    assert [(e.evidence_id, e.snippet_id) for e in got[1].packet] == [("E1", "x"), ("E2", "y")] and got[1].n_missing == 1
    claims = spark.createDataFrame([(1, "C1"), (1, "C2")], "r int, claim_id string")
    v = spark.createDataFrame([(1, "C1", " Supported ")], "r int, claim_id string, status string")
    assert rows(evidence.verified_claims(claims, v, ["r", "claim_id"], ["supported"], "insufficient"), "claim_id", "status") == [("C1", "supported"), ("C2", "insufficient")]


def test_blinded_packets_and_merge(spark):
    df = spark.createDataFrame([(1, [("C1", "t")]), (2, []), (3, None)], "k int, claims array<struct<claim_id:string,text:string>>")
    packet, key = annotate.blinded_packet(df, "k", "claims", 1)
    assert packet.count() == 3 and key.where("claim_id = 'NO-CLAIM'").count() == 2 and packet.select("blind_id").distinct().count() == 3
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(2, "y"), (3, "z")], "k int, l string")
    assert rows(annotate.merge_annotations(a, b, "k", "l"), "k", "found_in") == [(1, "only_a"), (2, "both"), (3, "only_b")]


def test_checks_and_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    got = {r.check_name: (r.passed, r.n_failed) for r in validate.run_checks(df, {"n": F.col("n") > 0, "s": F.col("s") == "a"}).collect()}
    assert got == {"n": (True, 0), "s": (False, 1)}
    h = lambda d: validate.content_hash(d).first().content_hash
    assert h(df) == h(df.orderBy(F.desc("n")).select("s", "n")) != h(df.where("n = 1"))
    with pytest.raises(Exception, match="broken"):
        validate.require(df, F.col("s").isNotNull(), "broken").collect()


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "k int, v double")
    r = bootstrap.interval(bootstrap.poisson_means(df, "k", "v", 40)).first()
    assert (r.n, r.mean, r.lower, r.upper, r.win_share) == (40, 1.0, 1.0, 1.0, 1.0)
    lo, hi, win = bootstrap.replay([0.0, 1.0, 2.0], 200)
    assert lo <= 1.0 <= hi and win > 0.9


def test_replay_interval_equals_replay(spark):
    r = random.Random(8)
    for n in (1, 7, 64, 300):
        values = [float(r.randrange(-9, 12)) for _ in range(n)]
        means = bootstrap.replay_means(values, 500)
        assert bootstrap.replay(values, 500) == (sorted(means)[12], sorted(means)[487], (means > 0).mean())
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "k long, v double").repartition(3)
    x = bootstrap.replay_interval(df, "k", "v").first()
    assert (x.n, x.lower, x.upper, x.win_share) == (10_000, *[round(v, 6) for v in bootstrap.replay(values)])
    assert bootstrap.replay_interval(df.limit(0), "k", "v").count() == 0


def test_answer_scores_are_resampled_in_full(spark, sf):
    from lucerna.plans import registry

    assert registry.queries()["bootstrap_answer_scores"](spark, sf).first().n == bootstrap.RESAMPLES == 10_000


def test_orphans_where_every_variant_is_null(spark, sf, tmp_path):
    import duckdb

    from lucerna.plans import general_problems as g

    c = duckdb.connect()
    for t in ("evidence_arms", "candidate_snippets", "reaudit_outputs", "claim_verifications"):
        cols = "* replace (null::varchar as variant)" if t == "claim_verifications" else "*"
        c.execute(f"copy (select {cols} from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = sorted(c.execute(f"select src_table, src_id, ref_field, ref_key, period, reason from ({g.ORACLE['p4_found']})").fetchall())
    assert any(x[2] == "evidence_ids" for x in want) and rows(g.p4_found(spark, str(tmp_path)), "src_table", "src_id", "ref_field", "ref_key", "period", "reason") == want


def test_pilot_bodies_are_pinned_to_dev(spark, tmp_path):
    from lucerna.plans import evaluation

    b = [(i, f"body {i}", ["p"] if i < 6 else ["o", None], "x") for i in range(10)] + [(10, None, None, "x"), (11, "body 0", None, "x")]
    spark.createDataFrame(b, "record_id long, normalised_body string, ids array<string>, question_type string").write.parquet(f"{tmp_path}/body_records.parquet")
    spark.createDataFrame([(1, "p"), (2, None)], "pilot_id long, question_id string").write.parquet(f"{tmp_path}/graph_claim_pilot_manifest.parquet")
    got = {r.assigned: r.n for r in evaluation.greedy_grouped_split(spark, str(tmp_path)).collect()}
    assert got["dev"] == 7 and sum(got.values()) == 12
