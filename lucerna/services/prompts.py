"""Prompts of the workload as columns, built from templates; null values become empty text."""

from __future__ import annotations

from pyspark.sql import Column

from .model_client import fill_prompt

GRAPH = """Read the evidence and list what it states as JSON with the keys entities, relations, answer_aspects, graph_sufficient and route_reason. Name for every relation and aspect the evidence ids it rests on.
Question ({question_type}): {question}
Evidence:
{evidence}"""

ANSWERS = """Answer twice, as JSON with the keys text_only and graph_assisted: once from the evidence alone, once with the edges as a guide. Give an answer and its claims, each with evidence ids and an importance, critical or supporting.
Question ({question_type}): {question}
Evidence:
{evidence}
Edges:
{edges}"""

VERIFIER = """Decide for every claim whether the evidence supports it: supported, contradicted or insufficient_evidence. Reply as JSON with the key verifications; each entry has claim_id, status, evidence_ids and brief_rationale.
Question: {question}
Evidence:
{evidence}
Claims:
{claims}"""

STRICT_VERIFIER = VERIFIER + """
A claim that goes beyond the evidence in number, group, direction or certainty is not supported. If the evidence says the opposite, it is contradicted; if it says nothing, insufficient_evidence."""

GENERATOR_OPEN = """Answer the question as JSON with the keys answer and claims.
Question ({question_type}): {question}"""

GENERATOR_CLOSED = """Answer the question from the evidence alone, as JSON with the keys answer, abstain and claims; each claim names its evidence ids. Abstain if the evidence does not answer it.
Question ({question_type}): {question}
Evidence:
{evidence}"""

PERTURBATION = """Change one detail of the claim so that it becomes {target}. Reply as JSON with the keys text, perturbation_type and changed_span.
Claim: {claim}
Evidence:
{evidence}"""

TEMPLATES = {"graph": GRAPH, "answers": ANSWERS, "verifier": VERIFIER, "strict_verifier": STRICT_VERIFIER, "generator_open": GENERATOR_OPEN, "generator_closed": GENERATOR_CLOSED, "perturbation": PERTURBATION}


def prompt(kind: str, **columns: Column) -> Column:
    """The prompt of a kind from the columns its template names."""
    return fill_prompt(TEMPLATES[kind], **columns)
