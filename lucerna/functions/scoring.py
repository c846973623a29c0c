"""Answer scoring that needs more than expressions: decomposition, item lists, LCS, matching.

Arrow-batched pandas UDFs over whole columns; each is also a plain function for tests.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import GREEK, score_form

# Generic words dropped in the lenient comparison.
GENERIC = "cancer disease disorder syndrome carcinoma tumor tumour protein gene mutation mutations"


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def decomposed(c: Column) -> Column:
    """NFKD; only text with characters beyond ASCII leaves the JVM."""
    plain = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, c).otherwise(_decomposed(F.when(~plain, c)))


def normal_form(c: Column) -> Column:
    """the scoring form of a text as it was written."""
    return score_form(decomposed(c))


_BORDER = re.compile(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
_ARTICLE = re.compile(r"\b(?:a|an|the)\b")


def normal_form_of(text: str) -> str:
    """F4 of one text, as ``normal_form`` gives it for a column."""
    t = unicodedata.normalize("NFKD", text)
    for letter, name in GREEK.items():
        t = t.replace(letter, f" {name} ")
    t = re.sub("[^a-z0-9]+", " ", _BORDER.sub(" ", t.lower()))
    return " ".join(_ARTICLE.sub(" ", t).split())


def _literal(text: str) -> list[str] | None:
    if not (text.startswith("[") and text.endswith("]")):
        return None
    try:
        v = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [str(x) for x in v] if isinstance(v, (list, tuple)) else None


def items_of(text: str | None) -> list[str]:
    """the items of a list answer: a bracketed literal, else by semicolons and lines, else by numbers, else by commas
    if it is short, else the whole; quotes and brackets around an item and repeats by normal form are dropped."""
    t = (text or "").strip()
    parts = _literal(t)
    if parts is None:
        t = re.sub(r"^[-*•]\s*", "", t)
        for pattern, short in ((r"[;\n]", False), (r"\b\d+[.)]\s+", False), (",", True)):
            if re.search(pattern, t) and not (short and len(t.split()) >= 40):
                parts = re.split(pattern, t)
                break
        else:
            parts = [t]
    kept: dict[str, str] = {}
    for p in parts:
        item = p.strip().strip("[]'\" ")
        if form := normal_form_of(item):
            kept.setdefault(form, item)
    return list(kept.values())


@F.pandas_udf(T.ArrayType(T.StringType()))
def answer_items(s: pd.Series) -> pd.Series:
    return s.map(items_of)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        m = where.get(w, 0)
        x = row | m
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


@F.pandas_udf(T.DoubleType())
def _rouge(a: pd.Series, refs: pd.Series) -> pd.Series:
    def one(x, rs) -> float:
        best = 0.0
        x = list(x) if x is not None else []
        for r in rs if rs is not None else []:
            r = list(r)
            n = lcs_length(x, r)
            if n:
                p, q = n / len(x), n / len(r)
                best = max(best, 2 * p * q / (p + q))
        return best

    return pd.Series([one(x, r) for x, r in zip(a, refs)])


def rouge_l(tokens: Column, reference_tokens: Column) -> Column:
    """best ROUGE-L F1 of a token array against an array of reference token arrays; 0 for empty or null."""
    return _rouge(tokens, reference_tokens)


def matching_size(links: list[list[int]], right: int) -> int:
    """Maximum matching of a bipartite graph given as neighbours of the left nodes."""
    taken = [-1] * right

    def place(u: int, seen: set[int]) -> bool:
        for v in links[u]:
            if v in seen:
                continue
            seen.add(v)
            if taken[v] < 0 or place(taken[v], seen):
                taken[v] = u
                return True
        return False

    return sum(place(u, set()) for u in range(len(links)))


def matched_f1(matrix) -> float:
    """List F1 from a predicted x gold boolean matrix: a prediction and a gold item pair at most once; 0 if either is empty."""
    rows = [list(r) for r in matrix] if matrix is not None else []
    if not rows or not rows[0]:
        return 0.0
    n = matching_size([[j for j, hit in enumerate(r) if hit] for r in rows], len(rows[0]))
    return 2 * n / (len(rows) + len(rows[0]))


def token_f1(a: list[str], b: list[str]) -> float:
    """F9 for lists: F1 of two token multisets."""
    n = sum((Counter(a) & Counter(b)).values())
    return 2 * n / (len(a) + len(b)) if n else 0.0


def items_match(a: list[str], b: list[str], least: float = 0.85) -> bool:
    """F10 for alias lists, lenient form."""
    return bool(set(a) & set(b)) or any(token_f1(x.split(), y.split()) >= least for x in a for y in b)


def list_f1(df: DataFrame, predicted: str, gold: str, out: str = "f1") -> DataFrame:
    """``df`` without its two columns of alias lists per item but with the list F1 of their best one-to-one matching."""
    kept = [c for c in df.columns if c not in (predicted, gold)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            score = [round(matched_f1([[items_match(x, y) for y in (g if g is not None else [])] for x in (p if p is not None else [])]), 6) for p, g in zip(pdf[predicted], pdf[gold])]
            yield pdf[kept].assign(**{out: score})

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in kept] + [f"{out} double"]))


def repaired_json(text: str | None) -> str | None:
    """a JSON object from a model's reply: fences dropped, the outermost object cut out, open strings and brackets
    closed, trailing commas removed; null if no object results."""
    if text is None:
        return None
    t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    start = t.find("{")
    if start < 0:
        return None
    t = t[start:]
    try:
        v, _ = json.JSONDecoder(strict=False).raw_decode(t)
        return json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else None
    except ValueError:
        pass
    stack, inside, skip, end = [], False, False, len(t)
    for i, ch in enumerate(t):
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"' or ch == "\\"
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    t = t[:end] + ('"' if inside else "")
    t = re.sub(r"[,:]\s*$", "", t) + "".join(reversed(stack))
    t = re.sub(r",\s*([}\]])", r"\1", t)
    t = re.sub(r'([{,]\s*"(?:[^"\\]|\\.)*")\s*([}\]])', r"\1: null\2", t) if stack[-1:] != ["]"] else t
    try:
        v = json.loads(t, strict=False)
    except ValueError:
        return None
    return json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else None


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(repaired_json)


def gold_values(answer: Column) -> Column:
    """a VARIANT answer as one flat list of texts: lists of lists are joined, a text alone is a list of one, null and
    empty text give none."""
    text = F.try_variant_get(answer, "$", "string")
    nested = F.flatten(F.transform(gold_groups(answer), lambda g: g))
    alone = F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.schema_of_variant(answer).startswith("ARRAY"), nested).otherwise(alone)


def gold_groups(answer: Column) -> Column:
    """a VARIANT list answer as groups of synonyms: an element that is no list is a group of one; no list gives none."""
    items = F.try_variant_get(answer, "$", "array<variant>")
    group = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$", "string")))
    return F.coalesce(F.transform(items, group), F.expr("cast(array() as array<array<string>>)"))


def gold_for(kind: Column, answer: Column) -> Column:
    """gold as ``scored`` takes it: a list question's groups of synonyms, for other types each value as a group."""
    return F.when(kind == "list", gold_groups(answer)).otherwise(F.transform(gold_values(answer), lambda x: F.array(x)))


_SCORE = "primary_score double, strict_score double"


def _alias_set(text: str, generic: frozenset[str]) -> set[str]:
    raw = [text, *(x.strip() for pair in re.findall(r"([^()]*)\(([^()]*)\)", text) for x in pair if x.strip())]
    forms = {normal_form_of(x) for x in raw}
    if generic:
        forms |= {" ".join(w for w in f.split() if w not in generic) for f in forms}
    return forms - {""}


def _same(a: set[str], b: set[str], lenient: bool) -> bool:
    return bool(a & b) or (lenient and any(token_f1(x.split(), y.split()) >= 0.85 for x in a for y in b))


def score_of(kind: str | None, answer: str | None, exact: list[list[str]], ideal: list[str]) -> tuple[float, float] | None:
    """(primary, strict) score of an answer by question type; None for a type without a rule.

    factoid: reciprocal place of the first item that matches any gold value; list: F1 of the best one-to-one matching
    of items to gold groups; yesno: the word matches; summary: best ROUGE-L.  Primary is lenient where the two differ.
    """
    answer = answer or ""
    if kind in ("factoid", "list"):
        items, out = items_of(answer), []
        for generic in (frozenset(GENERIC.split()), frozenset()):
            mine = [_alias_set(x, generic) for x in items]
            gold = [[_alias_set(x, generic) for x in group] for group in exact]
            hits = [[any(_same(m, g, bool(generic)) for g in group) for group in gold] for m in mine]
            if kind == "list":
                out.append(matched_f1(hits))
            else:
                out.append(next((1.0 / (i + 1) for i, row in enumerate(hits) if any(row)), 0.0))
        return out[0], out[1]
    if kind == "yesno":
        said = normal_form_of(answer).split()
        word = "yes" if "yes" in said else "no" if "no" in said else None
        score = float(word is not None and word == normal_form_of(" ".join(x for g in exact for x in g)))
        return score, score
    if kind == "summary":
        a, best = normal_form_of(answer).split(), 0.0
        for r in (normal_form_of(x).split() for x in ideal):
            n = lcs_length(a, r)
            best = max(best, 2 * n / (len(a) + len(r))) if n else best
        return best, best
    return None


def scored(df: DataFrame, kind: str, answer: str, exact: str, ideal: str) -> DataFrame:
    """``df`` with primary_score and strict_score; null where the type has no rule.

    ``exact`` is an array of groups of synonyms (see ``gold_for``), ``ideal`` an array of reference texts.
    """

    @F.pandas_udf(_SCORE)
    def score(k: pd.Series, a: pd.Series, e: pd.Series, i: pd.Series) -> pd.DataFrame:
        lists = lambda x: [list(y) for y in x] if x is not None else []
        rows = [score_of(kk, aa, lists(ee), list(ii) if ii is not None else []) or (None, None) for kk, aa, ee, ii in zip(k, a, e, i)]
        return pd.DataFrame(rows, columns=["primary_score", "strict_score"]).astype("float64")

    s = df.withColumn("_score", score(F.col(kind), F.col(answer), F.col(exact), F.col(ideal)))
    return s.withColumn("primary_score", F.nanvl("_score.primary_score", F.lit(None).cast("double"))).withColumn("strict_score", F.nanvl("_score.strict_score", F.lit(None).cast("double"))).drop("_score")
