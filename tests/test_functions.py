"""Scalar functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lucerna.functions import scoring, text


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("BRCA1, p53-mut", ["brca1", "p53", "mut"]), ("", []), ("α β", [])])
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("  A  B\n", "a b"), ("", ""), ("x", "x")])
def test_squeeze(spark, raw, want):
    assert one(spark, text.squeeze(F.col("t")), t=raw) == want


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    for f in (text.tokens, text.squeeze, text.alnum, text.yes_no, text.content_key, text.score_form):
        assert one(spark, f(null)) is None
    assert one(spark, text.word_count(null)) == 0


@pytest.mark.parametrize("raw,want", [("Yes and no", "yes"), ("No.", "no"), ("yesterday", None), ("", None)])
def test_yes_no(spark, raw, want):
    assert one(spark, text.yes_no(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("try again in 472.5ms", 0.4725), ("try again in 1h 12m 4s", 4324.0), ("Error code: 429", 60.0), ("boom", None)])
def test_retry_seconds(spark, raw, want):
    from lucerna.services.model_client import wait_seconds

    got = one(spark, text.retry_seconds(F.col("t")), t=raw)
    assert got == pytest.approx(want) if want is not None else got is None
    assert wait_seconds(raw) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(
    "raw,n", [("['p53', 'brca1']", 2), ("p53; brca1", 2), ("1. p53 2. brca1", 2), ("p53, brca1", 2), ("word " * 40 + ", x", 1), ("a; p53", 1), ("(p53, brca1)", 2), ("only 1. p53", 2), ("- p53\n- brca1", 2), ("[p53]", 1), ("", 0), (None, 0)]
)
def test_items(raw, n):
    assert len(scoring.items_of(raw)) == n


def test_alias_match(spark):
    a, b = F.lit("TNF-alpha (tumour necrosis factor)"), F.lit("TNF-α")
    assert one(spark, text.values_match(a, b)) is True
    assert one(spark, text.values_match(F.lit("lung cancer"), F.lit("lung"))) is False
    assert one(spark, text.values_match(F.lit("lung cancer"), F.lit("lung"), scoring.GENERIC)) is True
    assert one(spark, text.values_match(F.lit(None).cast("string"), b)) is False


@pytest.mark.parametrize("raw,want", [("TNFα", "tnf alpha"), ("αβ crystallin", "alpha beta crystallin"), ("Α", ""), ("The naïve IL6", "nai ve il 6"), ("a κ-B2", "kappa b 2"), ("", "")])
def test_normal_form(spark, raw, want):
    assert one(spark, scoring.normal_form(F.lit(raw))) == want == scoring.normal_form_of(raw)


@pytest.mark.parametrize(
    "kind,answer,exact,ideal,want",
    [
        ("factoid", "x; TNF-α", [["TNF alpha"]], [], (0.5, 0.5)), ("factoid", "lung", [["lung cancer"]], [], (1.0, 0.0)), ("factoid", "", [["a gene"]], [], (0.0, 0.0)), ("list", "p53, brca1, x", [["P53"], ["BRCA-1", "brca1"]], [], (0.8, 0.8)),
        ("list", "p53", [], [], (0.0, 0.0)), ("yesno", "Yes, in part.", [["yes"]], [], (1.0, 1.0)), ("yesno", "It may.", [["no"]], [], (0.0, 0.0)), ("summary", "b c d", [], ["x", "b x c"], (2 / 3, 2 / 3)), ("summary", "b", [], [], (0.0, 0.0)),
        ("essay", "b", [], [], None), (None, None, [], [], None),
    ],
)
def test_score_by_type(kind, answer, exact, ideal, want):
    got = scoring.score_of(kind, answer, exact, ideal)
    assert got == (None if want is None else pytest.approx(want))


def test_scored_column_and_gold(spark):
    df = spark.createDataFrame([(1, "list", "p53", '[["P53", "tp53"], "brca1"]'), (2, "yesno", "yes", '"yes"'), (3, "essay", "x", "null"), (4, "factoid", None, "[]")], "k int, kind string, a string, j string")
    df = df.withColumn("v", F.parse_json("j"))
    flat = {r.k: r.x for r in df.select("k", scoring.gold_values(F.col("v")).alias("x")).collect()}
    assert flat == {1: ["P53", "tp53", "brca1"], 2: ["yes"], 3: [], 4: []}
    s = scoring.scored(df.withColumn("g", scoring.gold_for(F.col("kind"), F.col("v"))).withColumn("i", F.array(F.lit("x"))), "kind", "a", "g", "i")
    got = {r.k: (r.primary_score, r.strict_score) for r in s.collect()}
    assert got == {1: (pytest.approx(2 / 3), pytest.approx(2 / 3)), 2: (1.0, 1.0), 3: (None, None), 4: (0.0, 0.0)}


def test_multiset_f1(spark):
    a, b = F.array(*[F.lit(x) for x in "a a b".split()]), F.array(*[F.lit(x) for x in "a b c".split()])
    assert one(spark, text.multiset_f1(a, b)) == pytest.approx(4 / 6)
    assert one(spark, text.multiset_f1(a, F.array().cast("array<string>"))) == 0.0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_matching():
    import random

    r = random.Random(1)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randrange(12))]
        b = [r.choice("abcd") for _ in range(r.randrange(12))]
        assert scoring.lcs_length(a, b) == brute_lcs(a, b)
    assert scoring.matching_size([[0, 1], [0]], 2) == 2
    assert scoring.matching_size([[0], [0]], 1) == 1
    assert scoring.matched_f1([[True, True]]) == pytest.approx(2 / 3)
    assert scoring.matched_f1(None) == 0.0 and scoring.matched_f1([]) == 0.0


@pytest.mark.parametrize("raw,want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": "b', '{"a": "b"}'), ('{"a": 1,}', '{"a": 1}'), ("no", None), (None, None), ("[1]", None)])
def test_json_repair(raw, want):
    assert scoring.repaired_json(raw) == want


def test_canonical_json(spark):
    got = one(spark, text.canonical_json({"b": F.lit("x"), "a": F.array(F.lit("p"), F.lit("q"))}))
    assert got == '{"a": ["p", "q"], "b": "x"}'


def test_bucket_and_budget(spark):
    assert [one(spark, text.bucket(F.lit(v), [0.4, 0.65], ["low", "medium", "high"])) for v in (0.1, 0.4, 0.65)] == ["low", "medium", "high"]
    assert one(spark, text.output_budget(F.lit(3), 900, 320, 3400)) == 1860


def test_texts_of_evidence_and_edges(spark):
    packet = F.array(F.struct(F.lit("E1").alias("evidence_id"), F.lit("x").alias("text")), F.struct(F.lit("E2").alias("evidence_id"), F.lit(None).cast("string").alias("text")))
    assert one(spark, text.evidence_text(packet)) == "[E1] x\n\n[E2] "
    none = F.lit(None).cast("array<struct<edge_id:string,source:string,relation:string,target:string>>")
    assert one(spark, text.edges_text(none)) == "NO_SUPPORTED_GRAPH_EDGE"


def test_claim_links_and_completeness(spark):
    from lucerna.operators import evidence

    ids, ok = F.array(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, evidence.claim_links(ids, ok)) == ["a", "b"] == one(spark, evidence.claim_links(ids, ok, F.lit("graph_assisted")))
    assert one(spark, evidence.claim_links(ids, ok, F.lit("text_only"))) == [] == one(spark, evidence.claim_links(F.lit(None).cast("array<string>"), ok))
    assert one(spark, evidence.verification_complete(ok, F.array(F.lit("b"), F.lit("a")))) is True
    assert one(spark, evidence.verification_complete(ok, F.array(F.lit("b")))) is False and one(spark, evidence.verification_complete(ok, F.lit(None).cast("array<string>"))) is False


def test_risk_and_graph_scores(spark):
    q = "Which gene is the target of the drug, and how does it regulate the pathway in cells while patients are treated for cancer?"
    assert one(spark, text.risk_score(F.lit("Summary "), F.lit(q))) == 2 + 1 + 0 + 0 + 1
    assert one(spark, text.risk_label(F.lit(4))) == "high" and one(spark, text.risk_score(F.lit(None).cast("string"), F.lit(None).cast("string"))) == 1
    # gene, target, regulate 3 each, pathway 4, "how does" 4, "which" with a term 2, long 1
    assert one(spark, text.graph_score(F.lit(q))) == 9 + 4 + 4 + 2 + 1 and one(spark, text.graph_score(F.lit(None).cast("string"))) == 0
