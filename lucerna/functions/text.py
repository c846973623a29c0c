"""Scalar text functions as Catalyst expressions.

Where Python's and Java's ideas of white space differ the Unicode classes are asked for.
Null in, null out, unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue words of the query-risk features, matched as whole words, case ignored.
RELATION_CUES = (
    "association associated relationship relation interact interaction effect affect cause causal mechanism role pathway "
    "regulate inhibit activate treat treatment therapy diagnos predict risk increase decrease"
)
COMPARISON_CUES = r"compare difference versus vs\.? better worse higher lower similar different most least"
CLAUSE_CUES = "and or while whereas however respectively"
EXPLANATION_STARTS = r"how|why|describe|explain|what are the mechanisms?"
# Where the risk score of a question starts, by its type; other types start at 1.
RISK_BASE = {"yesno": 0, "factoid": 0, "list": 1, "summary": 2}

# Weights of the graph-suitability terms (substring matches).
GRAPH_TERMS = {
    "mechanism": 4,
    "pathway": 4,
    "interact": 4,
    "interaction": 4,
    "inhibit": 4,
    "activate": 4,
    "relationship": 4,
    "target": 3,
    "receptor": 3,
    "gene": 3,
    "protein": 3,
    "mutation": 3,
    "mutated": 3,
    "associated": 3,
    "association": 3,
    "cause": 3,
    "causes": 3,
    "regulate": 3,
    "linked": 3,
    "biomarker": 3,
    "mediated": 3,
    "role": 2,
    "effect": 2,
    "affect": 2,
    "derived": 2,
    "responsible": 2,
}
# The bonuses of the graph-suitability score.
GRAPH_PHRASES, PHRASE_BONUS = ("how does", "what is the role"), 4
WHICH_TERMS, WHICH_BONUS = ("target", "gene", "protein", "receptor", "pathway"), 2
LONG_QUESTION, LENGTH_BONUS = 18, 1

# Greek letters spelled out by the scoring normaliser.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa"}


def _any_word(words: str) -> str:
    return r"(?i)\b(?:" + "|".join(words.split()) + r")\b"


def tokens(c: Column) -> Column:
    """runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def squeeze(c: Column) -> Column:
    """any Unicode white space to one blank, ends cut, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", ""))


def alnum(c: Column) -> Column:
    """everything but ASCII letters and digits to one blank, ends cut, lower case."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def word_count(c: Column) -> Column:
    """words between white space; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), F.lit(0))


def has_cue(c: Column, words: str) -> Column:
    """any of the words (regular expressions without blanks) as a whole word."""
    return F.coalesce(c.rlike(_any_word(words)), F.lit(False))


def starts_explaining(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"(?i)^\s*(?:{EXPLANATION_STARTS})\b"), F.lit(False))


def risk_score(kind: Column, question: Column) -> Column:
    """The start of the question's type plus one for each cue: relation, comparison, explanation, long with clauses."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_BASE.items() for x in kv]), F.lower(F.trim(F.coalesce(kind, F.lit("missing"))))), F.lit(1))
    cues = [has_cue(question, RELATION_CUES), has_cue(question, COMPARISON_CUES), starts_explaining(question), has_cue(question, CLAUSE_CUES) & (word_count(question) >= 12)]
    return reduce(lambda a, b: a + b, [c.cast("int") for c in cues], base)


def risk_label(score: Column) -> Column:
    """Up to 1 low, up to 3 medium, else high."""
    return F.when(score <= 1, "low").when(score <= 3, "medium").when(score.isNotNull(), "high")


def graph_score(c: Column, terms: dict[str, int] | None = None) -> Column:
    """Weights of the terms that occur as substrings of the alnum form, once each, and the three bonuses; null counts 0."""
    n = alnum(c)

    def holds(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in words])

    words = F.split(n, " ")
    parts = [F.when(F.contains(n, F.lit(t)), w).otherwise(0) for t, w in (terms or GRAPH_TERMS).items()]
    parts.append(F.when(holds(GRAPH_PHRASES), PHRASE_BONUS).otherwise(0))
    parts.append(F.when(F.array_contains(words, "which") & holds(WHICH_TERMS), WHICH_BONUS).otherwise(0))
    parts.append(F.when(F.size(words) >= LONG_QUESTION, LENGTH_BONUS).otherwise(0))
    return F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0))


def bucket(c: Column, edges: list[float], labels: list[str]) -> Column:
    """P5: the label of the first edge above the value (``labels`` has one more entry); null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for e, label in zip(edges, labels):
        out = out.when(c < e, label)
    return out.otherwise(labels[-1])


def spell_greek(c: Column) -> Column:
    """The lower-case letters of GREEK by name, set off by blanks."""
    out = c
    for k, v in GREEK.items():
        out = F.replace(out, F.lit(k), F.lit(f" {v} "))
    return out


def score_form(c: Column) -> Column:
    """F4 for text that is decomposed already: Greek spelled, letter/digit borders split, articles dropped."""
    t = F.lower(spell_greek(c))
    t = F.regexp_replace(t, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    t = F.regexp_replace(t, "[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"\b(?:a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def parenthesised(c: Column) -> Column:
    """the outside and the inside of each ``outside (inside)``."""
    pattern = F.lit(r"([^()]*)\(([^()]*)\)")
    both = F.concat(F.regexp_extract_all(c, pattern, 1), F.regexp_extract_all(c, pattern, 2))
    return F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != "")


def without_words(form: Column, words: str) -> Column:
    """F8: a normal form without the generic words."""
    kept = F.filter(F.split(form, " "), lambda w: ~w.isin(words.split()))
    return F.array_join(kept, " ")


def aliases(c: Column, generic: str | None = None) -> Column:
    """F8: normal forms of a value: itself, the parts around parentheses, each also without generic words."""
    raw = F.concat(F.array(c), parenthesised(c))
    forms = F.transform(raw, score_form)
    if generic:
        forms = F.flatten(F.transform(forms, lambda f: F.array(f, without_words(f, generic))))  # each form is made once
    return F.array_distinct(F.filter(forms, lambda f: f != ""))


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets; 0 if either is empty."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def aliases_match(x: Column, y: Column, lenient: bool = False, least: float = 0.85) -> Column:
    """F10/J11 on alias arrays made before: they overlap or, leniently, some token F1 reaches ``least``."""
    exact = F.arrays_overlap(x, y)
    if not lenient:
        return F.coalesce(exact, F.lit(False))
    near = F.exists(x, lambda p: F.exists(y, lambda q: multiset_f1(F.split(p, " "), F.split(q, " ")) >= least))
    return F.coalesce(exact, F.lit(False)) | F.coalesce(near, F.lit(False))


def values_match(a: Column, b: Column, generic: str | None = None, least: float = 0.85) -> Column:
    """strict by aliases, or lenient with ``generic`` words left out.  Null matches nothing."""
    return aliases_match(aliases(a, generic), aliases(b, generic), generic is not None, least)


def yes_no(c: Column) -> Column:
    """yes wins over no; null if neither stands as a word."""
    n = F.lower(c)
    return F.when(n.rlike(r"\byes\b"), "yes").when(n.rlike(r"\bno\b"), "no")


def content_key(c: Column) -> Column:
    """SHA-256 of the squeezed text."""
    return F.sha2(squeeze(c), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """an object by sorted keys with ", " and ": " between; values are strings or arrays of strings."""
    parts = [F.concat(F.lit(f'"{k}": '), F.regexp_replace(F.regexp_extract(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1), '","', '", "')) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def retry_seconds(c: Column, default: float = 60.0) -> Column:
    """the wait a rate-limit message asks for: h, m, s and ms summed; 429 without a time gives the default."""
    said = F.regexp_extract(F.lower(c), r"try again in ((?:\d+(?:\.\d+)?\s*(?:ms|h|m|s)\s*)+)", 1)

    def unit(u: str, factor: float) -> Column:
        found = F.regexp_extract(said, rf"(\d+(?:\.\d+)?)\s*{u}(?![a-z])", 1)
        return F.when(found == "", 0.0).otherwise(F.try_to_number(found, F.lit("999999999D999999")).cast("double") * factor)

    total = unit("h", 3600.0) + unit("m", 60.0) + unit("s", 1.0) + unit("ms", 0.001)
    return F.when(said != "", total).when(F.contains(c, F.lit("429")), F.lit(default))


def evidence_text(packet: Column) -> Column:
    """``[E1] text`` blocks of an ordered packet, a blank line between."""
    return F.array_join(F.transform(packet, lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("] "), F.coalesce(e["text"], F.lit("")))), "\n\n")


def edges_text(edges: Column, none: str = "NO_SUPPORTED_GRAPH_EDGE") -> Column:
    """one line per edge, or the marker for none."""
    lines = F.transform(edges, lambda e: F.concat_ws(" ", e["edge_id"], e["source"], e["relation"], e["target"]))
    return F.when(F.coalesce(F.size(edges), F.lit(0)) <= 0, none).otherwise(F.array_join(lines, "\n"))


def output_budget(n: Column, base: int, per: int, most: int, least: int = 0) -> Column:
    """base + per x n, held between least and most."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(base) + F.lit(per) * n))


def enum_order(c: Column, values: list[str]) -> Column:
    """T4: the place of a value in a fixed list, from 1; values outside come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.coalesce(F.nullif(place, F.lit(0).cast("long")), F.lit(len(values) + 1).cast("long")).cast("int")
