"""Local evidence graphs: clean-up and coverage selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of covered items by relevance, per selector.
WEIGHTS = {
    "broad": {"relation": {"high": 3.0, "medium": 2.0, "low": 0.5}, "aspect": {"high": 5.0, "medium": 3.0, "low": 1.0}},
    "strict": {"relation": {"high": 3.0, "medium": 2.0}, "aspect": {"high": 5.0, "medium": 3.0}},
}
#: Items that go on of each list, entities, relations and aspects.  ``clean_graph`` counts what is left out.
CAPS = (12, 16, 12)


def allowed_ids(ids: Column, allowed: Column) -> Column:
    """The ids that are allowed, first occurrence each, order kept."""
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(allowed, x)))


def clamp(c: Column, values: list[str], default: str) -> Column:
    """A value of the list, else the default; case and blanks at the ends do not count."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(values), v).otherwise(default)


def merged_rerank(ranked: Column, candidates: Column) -> Column:
    """The valid unique ranked ids, then the other candidates in their order."""
    return F.array_distinct(F.concat(F.filter(ranked, lambda x: F.array_contains(candidates, x)), candidates))


def clean_graph(entities: Column, relations: Column, aspects: Column, allowed: Column, caps: tuple[int, int, int] | None = CAPS) -> Column:
    """Entities with id and name; relations between known entities with allowed evidence; aspects with a
    description and allowed evidence; unknown relevance becomes low for relations, medium for aspects.

    ``caps`` limits the three lists as the workload does, None keeps them whole; ``over`` is how many items a cap left out.
    """
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    ents = F.filter(F.coalesce(entities, none("struct<entity_id:string,name:string,type:string>")), lambda e: (F.trim(F.coalesce(e["entity_id"], F.lit(""))) != "") & (F.trim(F.coalesce(e["name"], F.lit(""))) != ""))
    over = F.lit(0)
    if caps:
        over = F.greatest(F.size(ents) - caps[0], F.lit(0))
        ents = F.slice(ents, 1, caps[0])
    known = F.concat(F.transform(ents, lambda e: e["entity_id"]), F.transform(ents, lambda e: e["name"]))
    ok_ids = F.coalesce(allowed, F.array().cast("array<string>"))
    levels = ["high", "medium", "low"]

    def evidence(x: Column) -> Column:
        return allowed_ids(F.coalesce(x["evidence_snippet_ids"], F.array().cast("array<string>")), ok_ids)

    rels = F.transform(
        F.filter(relations, lambda r: r.isNotNull()),
        lambda r: F.struct(r["edge_id"].alias("edge_id"), r["source"].alias("source"), r["relation"].alias("relation"), r["target"].alias("target"), evidence(r).alias("evidence"), clamp(r["question_relevance"], levels, "low").alias("relevance")),
    )
    rels = F.filter(rels, lambda r: F.array_contains(known, r["source"]) & F.array_contains(known, r["target"]) & (F.size(r["evidence"]) > 0))
    asps = F.transform(F.filter(aspects, lambda a: a.isNotNull()), lambda a: F.struct(a["aspect_id"].alias("aspect_id"), a["description"].alias("description"), evidence(a).alias("evidence"), clamp(a["question_relevance"], levels, "medium").alias("relevance")))
    asps = F.filter(asps, lambda a: (F.trim(F.coalesce(a["description"], F.lit(""))) != "") & (F.size(a["evidence"]) > 0))
    if caps:
        over = over + F.greatest(F.size(rels) - caps[1], F.lit(0)) + F.greatest(F.size(asps) - caps[2], F.lit(0))
        rels, asps = F.slice(rels, 1, caps[1]), F.slice(asps, 1, caps[2])
    return F.struct(ents.alias("entities"), rels.alias("relations"), asps.alias("aspects"), over.alias("over"))


def select_by_coverage(candidates: list[str], items: list[tuple[str, str, str, list[str]]], mode: str = "strict", n: int = 5, fill: list[str] | None = None) -> list[tuple[int, str, int, str, float]]:
    """Greedy choice of ``n`` snippets from a ranked list.

    ``items`` are (key, kind, relevance, evidence ids).  ``broad``: marginal weight + .40 if not in ``fill`` + .25/rank,
    always picks.  ``strict``: low items do not count, the marginal weight must be positive, + .25 if not in ``fill``
    + .20/rank.  Ties: marginal, novelty, earlier rank, larger id.  What is missing is filled in the order of
    ``fill``, then of the ranking.  Rows: (order, id, rank, source, marginal weight).
    """
    w, fill = WEIGHTS[mode], fill or []
    bonus, per_rank = (0.40, 0.25) if mode == "broad" else (0.25, 0.20)
    weight = {k: w[kind][rel] for k, kind, rel, _ in items if rel in w[kind]}
    covers: dict[str, set[str]] = {}
    for k, _, _, ids in items:
        if k in weight:
            for i in ids:
                covers.setdefault(i, set()).add(k)
    rank = {s: i for i, s in reversed(list(enumerate(candidates, 1)))}
    covered: set[str] = set()
    out: list[tuple[int, str, int, str, float]] = []
    left = dict.fromkeys(candidates)
    while left and len(out) < n:
        def score(s: str):
            m = sum(weight[k] for k in covers.get(s, ()) if k not in covered)
            new = s not in fill
            return (m + bonus * new + per_rank / rank[s], m, new, -rank[s], s)

        pool = [score(s) for s in left]
        if mode == "strict":
            pool = [p for p in pool if p[1] > 0]
        if not pool:
            break
        _, m, _, _, s = max(pool)
        out.append((len(out) + 1, s, rank[s], "coverage", float(m)))
        covered |= covers.get(s, set())
        del left[s]
    for s in [*fill, *candidates]:
        if len(out) >= n:
            break
        if s in left:
            out.append((len(out) + 1, s, rank[s], "fill", 0.0))
            del left[s]
    return out


_TRACE = "selection_order int, snippet_id string, base_rank int, selection_source string, marginal_weight double"


def coverage_selection(df: DataFrame, key: str, mode: str = "strict", n: int = 5) -> DataFrame:
    """U4/U5 per row: (key, trace rows).  ``df`` has ``candidates`` (ranked ids), ``fill`` ids and ``graph`` from
    ``clean_graph``; a row is one question, so no shuffle is needed."""
    kind = dict(df.dtypes)[key]

    def run(parts):
        for pdf in parts:
            rows = []
            for k, cand, fill, g in zip(pdf[key], pdf["candidates"], pdf["fill"], pdf["graph"]):
                cand = list(dict.fromkeys(x for x in (cand if cand is not None else []) if x is not None))
                items = [(f"r{i}", "relation", r["relevance"], list(r["evidence"])) for i, r in enumerate(g["relations"] if g and g["relations"] is not None else [])]
                items += [(f"a{i}", "aspect", a["relevance"], list(a["evidence"])) for i, a in enumerate(g["aspects"] if g and g["aspects"] is not None else [])]
                rows += [(k, *t) for t in select_by_coverage(cand, items, mode, n, [x for x in (fill if fill is not None else []) if x is not None])]
            yield pd.DataFrame(rows, columns=[key, "selection_order", "snippet_id", "base_rank", "selection_source", "marginal_weight"])

    return df.select(key, "candidates", "fill", "graph").mapInPandas(run, f"{key} {kind}, {_TRACE}")


def set_changes(a: Column, b: Column) -> dict[str, Column]:
    """What a selection adds to and drops from another, and whether it differs as a set and as a list."""
    empty = F.array().cast("array<string>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return {
        "n_added": F.size(F.array_except(y, x)),
        "n_dropped": F.size(F.array_except(x, y)),
        "set_changed": F.array_sort(F.array_distinct(x)) != F.array_sort(F.array_distinct(y)),
        "list_changed": x != y,
    }
