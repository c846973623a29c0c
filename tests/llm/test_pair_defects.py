"""P1 on hand-made pairs."""

import pytest

from lucerna.llm import pair_defects as P

CASES = [
    ("Which gene is mutated in X?", None, "empty"),
    ("Which gene is mutated in X?", " \t ", "empty"),
    ("Which gene is mutated in X?", "[]", "empty"),
    ("Which gene is mutated in X?", "N/A", "empty"),
    ("Which gene is mutated in X?", "...", "empty"),
    ("Is it safe?", "No", None),
    ("Is it safe?", "No.", None),
    ("What is the dose?", "50 mg", None),
    ("Which enzyme is blocked?", "QPKFW17, a kinase", None),
    ("Which events were seen?", "nausea, dry cough, headache", None),
    ("Which events were seen?", "nausea\n- dry cough\n- elevated liver enzymes", None),
    ("Which gene is mutated in X?", "**Question** which gene is mutated in x", "copies_question"),
    ("Which gene is mutated in X?", "Which gene is mutated in X? Which gene is mutated in X?", "copies_question"),
    ("Which gene is mutated in X?", "Which gene is mutated in X? ABC12 is the gene.", None),
    ("Is it safe?", "I'm sorry, but I can’t help with that request.", "refusal"),
    ("Is it safe?", "Participants who declined to answer the survey were left out of the trial.", None),
    ("Is it safe?", "Patients unable to tolerate it were moved to another drug after 3 weeks.", None),
    ("Ist es sicher?", "Dazu darf ich leider keine Auskunft geben.", "refusal"),
    ("¿Es seguro el fármaco para los niños?", "Lo siento, pero no puedo responder a esa solicitud.", "refusal"),
    ("What does the drug do in the liver?", "Die Behandlung mit der Substanz wurde nach der Studie beendet.", "other_language"),
    ("What does the drug do in the liver?", "Лечение следует прекратить при плохой функции почек.", "other_language"),
    ("Какова роль гена?", "The gene is active in the liver and protects from the disease.", "other_language"),
    ("What does the drug do in the liver?", "The drug blocks the enzyme in the liver and", "truncated"),
    ("What does the drug do in the liver?", "The drug blocks the enz…", "truncated"),
    ("What does the drug do in the liver?", "It blocks the enzyme (p = 0.", "truncated"),
    ("What does the drug do in the liver?", "It blocks the enzyme (p = 0.3).", None),
    ("What does the drug do in the liver?", "The drug blocks the enzyme because of-", "truncated"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, q, a, " Release ", a) for i, (q, a, _) in enumerate(CASES)], "pair_id bigint, question string, bge_answer string, bge_final_disposition string, hybrid_answer string")
    got = {r.pair_id: r.defect for r in P.defects(df).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (_, _, d) in enumerate(CASES)}


def test_only_released_and_nulls(spark):
    df = spark.createDataFrame([(1, "q?", None, None, None), (2, "q?", None, "abstain", None), (3, None, "The answer is in the liver.", "RELEASE", None), (4, None, None, "release", None)], "pair_id bigint, question string, bge_answer string, bge_final_disposition string, hybrid_answer string")
    assert [(r.pair_id, r.defect) for r in P.defects(df).collect()] == [(4, "empty")]
    assert P.defects(df.limit(0)).count() == 0


def test_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "q?", "", "release", "", 5, 6)] * 2, "pair_id bigint, question string, bge_answer string, bge_final_disposition string, hybrid_answer string, n int, t int")
    assert [(r.pair_id, r.defect) for r in P.defects(df).distinct().collect()] == [(1, "empty")]


def test_prefix_neighbours_equal_brute_force(spark):
    import random

    from lucerna.workspace import Workspace

    r = random.Random(2)
    texts = {"".join(r.choice("ab ") for _ in range(r.randrange(1, 7))) for _ in range(300)}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("aa",), ("aa",)], "t string")
    got = {x.t for x in P.prefix_neighbours(df, Workspace(spark, "test")).collect()}
    assert got == {t for t in texts | {"aa"} if any(u != t and u.startswith(t) for u in texts | {"aa"})}


def test_spikes(spark):
    lengths = [80] * 60 + list(range(40, 140)) * 2
    got = [r.n for r in P.length_spikes(spark.createDataFrame([(n,) for n in lengths], "n int")).collect()]
    assert got == [80]
    assert P.length_spikes(spark.createDataFrame([], "n int")).count() == 0


@pytest.mark.parametrize("text,lang", [("The drug is given in the morning", "en"), ("Le traitement par le médicament est fini", "fr"), ("In uno studio della malattia il farmaco è stato", "it"), ("QPKFW17", None), ("Препарат помогает детям", "ru")])
def test_language(text, lang):
    assert P.language(text, set(P._WORD.findall(text.lower())))[0] == lang


@pytest.mark.parametrize(
    "text",
    [
        "It is better not to stop the drug abruptly.", "The system does not support replication of the virus.", "The model cannot provide glucose to the tissue.", "Vaccination works against our most common strains.",
        "The request was denied by the ethics board, but 40% responded.", "We do not discuss relapse as an endpoint; overall survival was longer.", "The question was rejected by the panel after two rounds of voting.",
        "I am sorry that this took long. The gene is ABC12, and it is mutated in one third of all patients with the disease. It lies on chromosome 4.", "We cannot help but note that response rates doubled in all arms of the trial after week nine.",
        "Patients who refuse to answer were excluded.", "No information can be drawn from the second arm.", "Unfortunately, all patients relapsed.", "As a language model organism, the zebra finch is used.",
    ],
)
def test_answers_that_do_not_refuse(text):
    assert not P.refuses(text)


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry.", "I cannot provide medical advice. Please consult a physician.", "Thank you for the question, but I must decline to answer this question.", "That is a good question. This falls under topics the assistant does not cover.",
        "My guidelines do not let me respond to this.", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Я не вправе давать медицинские советы о препарате.", "We are unable to give advice on this. Is there something else I can help with?",
    ],
)
def test_answers_that_refuse(text):
    assert P.refuses(text)


def test_each_step_gives_rows(spark):
    """Shortened versions are shown by their neighbour, gathered lengths by the limit, and only the rest by the ending."""
    whole = "Carriers with the condition need screening for the variant before treatment."
    data = [(1, whole), (2, whole[:47]), (3, "Carriers with the condition need screening")]
    data += [(100 + i, (f"drug{i} reduced symptom scores markedly, again " + "a" * 90)[:90].replace(",", "")) for i in range(10, 50)]
    data += [(200, "The drug blocks the enzyme in the liver and"), (201, "drug a\ndrug b"), (202, "joint pain")]
    df = spark.createDataFrame([(k, "What is known?", a, "release", None) for k, a in data], "pair_id bigint, question string, bge_answer string, bge_final_disposition string, hybrid_answer string")
    got = {r.pair_id: r.evidence for r in P.defects(df).collect() if r.defect == "truncated"}
    assert got[2] == "prefix" and 1 not in got and 201 not in got and 202 not in got and got[200] == "ending"
    assert {got[k] for k, _ in data if 100 < k < 200} == {"limit"}
