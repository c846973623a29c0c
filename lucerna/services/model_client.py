"""Calls to hosted models behind a small interface.

The engine ships a deterministic offline client.  Calls run in ``mapInPandas`` on a table of work units, never
inside an expression, so that they happen once per unit; results carry what is needed to resume.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import repaired_json

CALL = "call_name string, model string, attempt int, response_mode string, latency_ms double, raw_response string, json_repaired boolean, waits int, issues array<string>"


class ModelError(Exception):
    """A call that failed; the message may ask to wait."""


class ModelClient(Protocol):
    """One request: messages in, text out.  ``mode`` is json or plain."""

    model: str

    def complete(self, prompt: str, mode: str, budget: int) -> str: ...


@dataclass
class OfflineClient:
    """Deterministic stand-in: answers from a hash of the prompt, or from a function for tests."""

    model: str = "offline"
    answer: Callable[[str], str] | None = None

    def complete(self, prompt: str, mode: str, budget: int) -> str:
        if self.answer:
            return self.answer(prompt)
        h = hashlib.sha256(prompt.encode()).hexdigest()
        return json.dumps({"answer": h[:12], "abstain": int(h[0], 16) < 2, "claims": [{"claim_id": "C1", "text": h[12:24]}]})


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def wait_seconds(message: str, default: float = 60.0) -> float | None:
    """F22 on the driver or a worker: the wait a message asks for; a 429 without a time gives the default."""
    m = re.search(r"try again in ((?:\d+(?:\.\d+)?\s*(?:ms|h|m|s)\s*)+)", message.lower())
    if m:
        return sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)\s*(ms|h|m|s)", m[1]))
    return default if "429" in message else None


@dataclass
class Policy:
    """How a structured call is tried: JSON mode, repair, plain mode; waits do not use up tries."""

    json_tries: int = 3
    plain_tries: int = 3
    budget: int = 1200
    grow: float = 1.35
    grow_by: int = 250
    most: int = 6000
    spacing: float = 0.0
    pad: float = 5.0
    most_wait: float = 1800.0
    most_waits: int = 20
    sleep: Callable[[float], None] = field(default=time.sleep)


def structured_call(client: ModelClient, prompt: str, policy: Policy, issues_of: Callable[[dict], list[str]] | None = None) -> dict:
    """The first reply that is a JSON object without issues, else the last object; issues are fed back."""
    waits, attempt, last, budget, started = 0, 0, None, policy.budget, time.perf_counter()
    for mode, tries in (("json", policy.json_tries), ("plain", policy.plain_tries)):
        done = 0
        while done < tries:
            attempt += 1
            try:
                raw = client.complete(prompt, mode, budget)
            except ModelError as e:
                pause = wait_seconds(str(e))
                if pause is not None and waits < policy.most_waits and pause <= policy.most_wait:
                    waits += 1
                    policy.sleep(pause + policy.pad)
                    continue
                done += 1
                continue
            done += 1
            fixed = repaired_json(raw)
            if fixed is None:
                continue
            value = json.loads(fixed)
            try:
                repaired = json.loads(raw) != value
            except ValueError:
                repaired = True
            issues = issues_of(value) if issues_of else []
            last = {"call_name": "structured", "model": client.model, "attempt": attempt, "response_mode": mode, "raw_response": fixed, "json_repaired": repaired, "waits": waits, "issues": issues}
            if not issues:
                return last | {"latency_ms": (time.perf_counter() - started) * 1000}
            prompt += "\n\nThe last reply was incomplete: " + "; ".join(issues)
            budget = min(policy.most, int(budget * policy.grow) + policy.grow_by)
            policy.sleep(policy.spacing)
    none = {"call_name": "structured", "model": client.model, "attempt": attempt, "response_mode": "plain", "raw_response": None, "json_repaired": False, "waits": waits, "issues": ["no_reply"]}
    return (last or none) | {"latency_ms": (time.perf_counter() - started) * 1000}


def run_jobs(units: DataFrame, key: str, prompt: str, make_client: Callable[[], ModelClient], policy: Policy | None = None, issues_of: Callable[[dict], list[str]] | None = None, partitions: int | None = None) -> DataFrame:
    """One call per unit, in parallel over ``partitions``; the client is made once per task, and only if it has work."""
    kind = dict(units.dtypes)[key]
    rules = policy or Policy()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for pdf in parts:
            if len(pdf) and client is None:
                client = make_client()
            rows = [structured_call(client, p or "", rules, issues_of) for p in pdf[prompt]]
            out = pd.DataFrame(rows, columns=["call_name", "model", "attempt", "response_mode", "latency_ms", "raw_response", "json_repaired", "waits", "issues"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    u = units.select(key, prompt)
    return (u.repartition(partitions, key) if partitions else u).mapInPandas(run, f"{key} {kind}, {CALL}")


def choose_model(catalogue: DataFrame, column: str, preferred: list[str], excluded: list[str]) -> DataFrame:
    """One row: the first preferred model that the catalogue lists, else the first by name; excluded terms drop out."""
    c = catalogue.where(F.col(column).isNotNull())
    for term in excluded:
        c = c.where(~F.contains(F.lower(column), F.lit(term.lower())))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(column)), F.lit(0)), F.lit(len(preferred) + 1))
    return c.agg(F.min_by(column, F.struct(order, F.col(column))).alias("model"), F.count(F.lit(1)).alias("n_eligible"))


def fill_prompt(template: str, **columns):
    """A prompt column from a template with {names}; null values become empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(columns[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
