"""P5, P6, P7 and P10 on small tables and against brute force."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lucerna.llm import confusables as C
from lucerna.llm import formatting_duplicates as D
from lucerna.llm import split_overlap as O
from lucerna.llm import truncation as T


# P5

OBJ = {"a": {"verifications": [{"id": "T1", "why": "It is so."}, {"id": "T2", "why": "exact match"}, {"id": "T3", "why": "It is not."}]}}
WHOLE = json.dumps(OBJ)


@pytest.mark.parametrize(
    "text,verdict",
    [
        (WHOLE, "ended"), (f"```json\n{WHOLE}\n```", "ended"), (f"```json\n{WHOLE}\n```\nEnd of report.", "ended"), (WHOLE + "\nEnd of report.", "ended"), (f"```json\n{WHOLE}", "open"),
        (WHOLE[:-5], "open"), (WHOLE[:40], "open"), ('{"a": [{"id": "x", "why": "w."}, {"id": "y"}]}', "open"), ('{"a": [{"id": "x", "why": "broken of"}]}', "unsure"), ("All is well.", "ended"),
        ("All is we", "open"), ("- T1: supported\n- T2: supported", "unsure"), ("- T1: supported\n- T2: all.", "ended"), ("", "ended"), ("It ends (p = 0.3).", "ended"), ("It ends (p = 0.", "open"), ("It (a) ends.", "ended"), ("[]", "ended"), ("{}", "ended"),
    ],
)
def test_endings(text, verdict):
    assert T.ending_of(text)[1] == verdict


@pytest.mark.parametrize("text", ["plain", 'a "b" <c> & d\n\r\n\t é 𝛼 \\ \x01', "", "😀😀"])
def test_measures(text):
    import html

    got = dict(zip(T.MEASURES, T.sizes_of(text)))
    esc = html.escape(text).replace("&#x27;", "&#39;x")  # the same length as the named form
    js, ja = json.dumps(text, ensure_ascii=False)[1:-1], json.dumps(text)[1:-1]
    crlf = re.sub(r"(?<!\r)\n", "\r\n", text)
    assert got == {
        "points": len(text), "utf8": len(text.encode()), "utf16": len(text.encode("utf-16-le")) // 2, "entities": len(esc), "entities_utf8": len(esc.encode()), "json": len(js), "json_utf8": len(js.encode()), "json_ascii": len(ja),
        "crlf": len(crlf), "crlf_utf8": len(crlf.encode()),
    }


def test_truncation_of_a_corpus(spark):
    r = random.Random(3)
    data = [(i, "m", json.dumps({"x": [{"id": str(i), "why": r.choice(["exact match", "It holds."])}, {"id": "z", "why": "exact match"}]})) for i in range(30)]
    long = "word " * 40
    data += [(100 + i, "n", (f"start {i} " + long)[:120]) for i in range(40)] + [(200 + i, "n", (f"start {i} " + long)[: 60 + i] + ".") for i in range(30)]
    data += [(300, "m", json.dumps({"x": [{"id": "1", "why": "Loss of"}]})), (301, "m", None), (302, None, "It is"), (303, "m", "")]
    df = spark.createDataFrame(data, "k bigint, s string, t string")
    got = {x.k: x for x in T.truncated(df, "k", "t", "s").collect()}
    assert 301 not in got and len(got) == len(data) - 1
    assert {k for k, x in got.items() if x.truncated} == {*range(100, 140), 300, 302}
    lim = T.limits(T.examine(df, "k", "t", "s"), "s").where("measure = 'points'").collect()
    assert [(x.s, x.size, x.n_unfinished) for x in lim] == [("n", 120, 40)]
    assert T.truncated(df.limit(0), "k", "t", "s").count() == 0
    assert {(x.limit_measure, x.limit_size) for x in got.values() if x.limit_measure} == {("points", 120)}


def test_a_limit_lowers_the_evidence(spark):
    """Cut at a limit after a full stop or known phrase; complete replies at the limit or elsewhere stay."""
    r = random.Random(5)

    def say(i, rounds, n=5):
        return "\n".join(f"text_only T{k}: supported. Seen in {r.randrange(10, 99)} of them." for _ in range(rounds) for k in range(1, n + 1))

    def padded(t, size):
        t = (t + " Checked again." * 40)[: size - 20].rsplit(".", 1)[0] + ". Confidence 0."
        return t + "5" * (size - len(t) - 1) + "."

    def mended(size, why, last="T5"):
        one = lambda k, w: {"id": k, "why": w}
        t = json.dumps([one("T1", "It holds."), one(last, "")])
        fill = "x" * (size - len(t) + len('"}]') - len(why)) + "It holds."
        return json.dumps([one("T1", fill), one(last, why)])

    after_stop = say(0, 4)[:700]
    after_stop = after_stop[: after_stop.rindex(".") + 1]
    size = len(after_stop)  # the last of four rounds stops after a full stop
    data = [(i, "m", say(i, 4)[: size - 9] + " and so on") for i in range(20)]
    data = [(i, s, t[:size]) for i, s, t in data]
    data += [(100, "m", after_stop), (101, "n", after_stop), (102, "m", padded(say(0, 1), size)), (103, "m", say(0, 1)), (104, "m", say(0, 3))]
    data += [(110, "m", mended(size, "exact match")), (111, "n", mended(size, "exact match")), (112, "m", mended(size - 60, "exact match"))]
    data += [(113, "m", mended(size, "It is so.", "T4")), (114, "m", mended(size, "It is so."))]
    data += [(200 + i, "n", json.dumps([{"id": "T1", "why": "exact match"}, {"id": "T5", "why": "It holds."}])) for i in range(5)]
    assert len(data[20][2]) == len(data[22][2]) == size
    df = spark.createDataFrame([(k, s, t, [f"T{i}" for i in range(1, 6)]) for k, s, t in data], "k bigint, s string, t string, x array<string>")
    got = {x.k: x for x in T.truncated(df, "k", "t", "s", "x").collect()}
    assert {k for k, x in got.items() if x.truncated} == {*range(20), 100, 110, 113}
    assert got[100].limit_measure and got[110].limit_measure and got[114].limit_measure is None
    without = {x.k for x in T.truncated(df, "k", "t", "s", "x", with_limits=False).collect() if x.truncated}
    assert without == {*range(20)}  # the limits decide the others


def test_more_data_clears_no_phrase(spark):
    """A cut phrase that now and then stands whole elsewhere stays cut at ten times the data."""
    cut, whole = "Dose and group", "exact match"

    def reply(i, last):
        return json.dumps({"x": [{"id": str(i), "why": "It holds" + "x" * (i * 37 % 997) + "."}, {"id": "y", "why": whole}, {"id": "z", "why": last}]})

    def found(times):
        data = [(i, "m", reply(i, cut)) for i in range(6 * times)] + [(10_000 + i, "m", reply(i, whole)) for i in range(6 * times)]
        data += [(20_000 + i, "m", json.dumps({"x": [{"id": "a", "why": cut}, {"id": "b", "why": "It is."}]})) for i in range(times)]
        got = T.truncated(spark.createDataFrame(data, "k bigint, s string, t string"), "k", "t", "s").where("truncated").collect()
        return {x.k for x in got}, {i for i in range(6 * times)}

    for times in (1, 10):
        got, want = found(times)
        assert got == want


# P6

COLS = {"b": D.body_token, "i": D.set_tokens, "e": D.json_tokens}


def test_collapse(spark):
    data = [
        (1, "What is X?", ["a", "b"], '{"r": 1, "t": "x"}'), (2, "what  is x", ["b", "a", "a"], '{"t":"x","r":1}'), (3, "what is x", ["a"], '{"r": 1, "t": "x"}'), (4, "what is x", ["a", "b"], '{"r": "1", "t": "x"}'),
        (5, None, None, None), (6, None, [], "{}"), (7, "", None, None), (8, "!", [None], " {} "), (9, "what is x", ["a", "b"], "no json"), (10, "WHAT IS X", ["b", "a"], " no json"), (11, "what is xy", ["a", "b"], '{"r": 1, "t": "x"}'),
    ]
    df = spark.createDataFrame(data, "k bigint, b string, i array<string>, e string")
    got = {r.k: (r.keep_id, r.copies) for r in D.collapse(df, "k", COLS).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 2), 6: (5, 2), 7: (7, 2), 8: (7, 2), 9: (9, 2), 10: (9, 2), 11: (11, 1)}
    assert D.collapse(df.limit(0), "k", COLS).count() == 0


def test_hot_value_is_salted(spark):
    df = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit("Same text")).otherwise(F.concat(F.lit("t"), "id")).alias("b"), F.array(F.lit("a")).alias("i"), F.lit("{}").alias("e"))
    got = D.collapse(df, "k", COLS).groupBy("keep_id").count().where("count > 1").collect()
    assert [(r.keep_id, r["count"]) for r in got] == [(1, 20_000)]


def test_hot_token_is_salted(spark):
    """One id in all lists, though no two lists are equal."""
    df = spark.range(25_000).select(F.col("id").alias("k"), F.lit("x").alias("b"), F.array(F.lit("hot"), F.concat(F.lit("i"), (F.col("id") % 24_990).cast("string"))).alias("i"), F.lit("{}").alias("e"))
    got = {(r.k, r.keep_id) for r in D.collapse(df, "k", COLS).where("k <> keep_id").collect()}
    assert got == {(24_990 + i, i) for i in range(10)}


# P7


def test_overlap_equals_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(12)]

    def text():
        return [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16]))]

    def edited(t):
        t = list(t)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(t) + 1)
            how = r.randrange(3)
            if how == 0:
                t.insert(at, r.choice(vocab))
            elif t:
                at = min(at, len(t) - 1)
                t[at : at + 1] = [] if how == 1 else [r.choice(vocab)]
        return t

    tr = [text() for _ in range(120)]
    ev = [edited(r.choice(tr)) if r.random() < 0.7 else text() for _ in range(80)]
    spell = lambda t: r.choice([" ", ", ", "  - "]).join(w.upper() if r.random() < 0.3 else w for w in t)
    e = spark.createDataFrame([("e", i, spell(t)) for i, t in enumerate(ev)] + [("e", 999, None)], "tab string, id bigint, text string")
    t = spark.createDataFrame([(i, spell(x)) for i, x in enumerate(tr)] + [(999, None)], "id bigint, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {("e", i, j) for i, a in enumerate(ev) for j, b in enumerate(tr) if distance(a, b) <= 2}
    got = {(x.tab, x.id, x.train_id) for x in O.overlap_pairs(e, t).collect()}
    assert got == want
    per = {x.id for x in O.overlapping_records(e, t).collect()}
    assert per == {i for _, i, _ in want}
    assert O.overlap_pairs(e.limit(0), t).count() == 0 and O.overlap_pairs(e, t.limit(0)).count() == 0


def test_hot_training_text_and_short_texts(spark):
    """A third of training says the same, another third is one word long; classes are paired, rows only named."""
    same = "what is known about the role of this gene in the disease"
    tr = spark.range(66_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(same)).when(F.col("id") % 3 == 1, F.lit("what")).otherwise(F.concat(F.lit("entirely other text number "), "id", F.lit(" which shares nothing with the others at all"))).alias("text"))
    ev = spark.createDataFrame([("e", 1, same.replace("gene", "protein")), ("e", 2, "What?"), ("e", 3, "what is it"), ("e", 4, None), ("e", 5, "no")], "tab string, id bigint, text string")
    per = {r.id: (r.n_classes, r.exact) for r in O.overlapping_records(ev, tr).collect()}
    assert per == {1: (1, False), 2: (1, True), 3: (1, False), 5: (1, False)}
    n = {r.id: r["count"] for r in O.overlap_pairs(ev, tr).groupBy("id").count().collect()}
    assert n == {1: 22_000, 2: 22_000, 3: 22_000, 5: 22_000}


def test_within():
    assert O.within([], ["a", "b"], 2) and not O.within([], ["a", "b", "c"], 2) and O.within(["a"], ["b"], 1)


# P10


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("naïve", "naïve", True), ("ａｂｃ １２", "abc 12", True), ("a b", "a b", True), ("self‐made", "self-made", True), ("ze​ro﻿", "zero", True), ("расе", "pace", True), ("Ηello", "Hello", True), ("µg", "μg", True),
        ("K", "K", True), ("soft­hyphen", "softhyphen", True), ("10⁹", "109", False), ("naïve", "naive", False), ("Abc", "abc", False), ("a b", "a  b", False), ("a\nb", "a b", False), ("TNF-α", "TNF-a", False), ("a–b", "a-b", False),
        ("ё", "ё", True), ("", "​", True), ("ﬁn", "fin", True),
    ],
)
def test_skeletons(a, b, same):
    assert (C.skeleton_of(a) == C.skeleton_of(b)) is same


def test_skeleton_column_and_pairs(spark):
    data = [(1, "naïve text"), (2, "naïve text"), (3, "naïve text"), (4, "naive text"), (5, None), (6, ""), (7, ""), (8, "ｎaïve text"), (9, "x" * 100_000 + "é"), (10, "x" * 100_000 + "é"), (11, "tab\tb"), (12, "tab b")]
    df = spark.createDataFrame([(i, t, t) for i, t in data], "doc_id bigint, text string, class_id string").select("doc_id", "text", "class_id")
    want = {(a, b) for a, x in data for b, y in data if a < b and x is not None and y is not None and x != y and C.skeleton_of(x) == C.skeleton_of(y)}
    assert set(map(tuple, C.look_alike_pairs(df).collect())) == want and (1, 3) not in want and (9, 10) in want
    forms = {r.doc_id: (r.canonical, r.changed) for r in C.consistent_form(df).collect()}
    assert forms[2][0] == forms[1][0] == unicodedata.normalize("NFC", "naïve text") and forms[5] == (None, None) and forms[6] == ("", False)
    assert C.look_alike_pairs(df.limit(0)).count() == 0
    assert {r.doc_id for r in C.look_alike_classes(df).collect()} == {i for p in want for i in p}


def test_copies_of_a_hot_text_meet_only_the_others(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("na\u00efve")).when(F.col("id") == 1, F.lit("nai\u0308ve")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = C.look_alike_pairs(df)
    assert got.count() == 10_000 and got.where("a = 1 or b = 1").count() == 10_000


def test_public_table(tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("\ufeff# remark\n0251 ;\t0061 ;\tMA\t# x\n03B1 ; 0061 ; MA\n0030 ; 004F ; MA\n0661 ; 006C ; MA\n13A0 ; 0044 ; MA\n006D ; 0072 006E ; MA\n")
    assert C.read_table(str(f)) == {0x251: "a", 0x13A0: "D"} and C.skeleton_of("ɑα", str(f)) == "aα"
