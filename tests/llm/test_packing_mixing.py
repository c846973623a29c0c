"""Exact round trips and bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import mixing as M
from lucerna.llm import packing as P
from lucerna.llm import tokens


def test_differencing_is_balanced_and_complete():
    r = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 1), (5, 8), (40, 4), (300, 17), (1000, 60)):
        sizes = np.sort(r.integers(1, 200, n))[::-1]
        w = P.difference(sizes, k)
        assert len(w) == n and (n == 0 or (w.min() >= 0 and w.max() < k))
        if n >= 8 * k:
            fill = np.bincount(w, weights=sizes, minlength=k)
            assert fill.max() - fill.min() <= sizes.max()


def test_pack_respects_capacity():
    r = np.random.default_rng(2)
    for _ in range(20):
        sizes = r.integers(1, 101, r.integers(1, 200))
        w = P.pack(sizes, 100)
        fill = np.bincount(w, weights=sizes)
        assert fill.max() <= 100
        assert len(fill) <= 2 * -(-sizes.sum() // 100) + 1


def test_fill_containers_round_trip(spark):
    r = random.Random(4)
    data = [(i, r.choice([3, 40, 99, 100, 101, 250, 1000])) for i in range(600)] + [(900, 0), (901, None), (902, -5)]
    items = spark.createDataFrame([(i, s, "clash") for i, s in data], "doc_id bigint, tokens bigint, size string")
    cont = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 0), ("d", None)], "container string, capacity_tokens int")
    out = P.fill_containers(items, cont, block_items=150)
    rows = out.collect()
    for name, cap in (("a", 100), ("b", 1000)):
        mine = [x for x in rows if x.container == name]
        per, fill = {}, {}
        for x in mine:
            per[x.doc_id] = per.get(x.doc_id, 0) + x.size
            fill[x.window_id] = fill.get(x.window_id, 0) + x.size
        assert per == {str(i): s for i, s in data if s and s > 0}
        assert max(fill.values()) <= cap
        assert all((x.piece == 0) == (dict(data)[int(x.doc_id)] <= cap) for x in mine)
        assert 1 - sum(fill.values()) / (len(fill) * cap) < 0.06
    assert {x.container for x in rows} == {"a", "b"}
    s = {x.container: x for x in P.summary(out, cont.where("capacity_tokens > 0")).collect()}
    assert s["a"].fullest <= 100 and s["a"].n_pieces == sum(x.container == "a" for x in rows)
    assert P.fill_containers(items.limit(0), cont).count() == 0 and P.fill_containers(items, cont.limit(0)).count() == 0


def test_water_fill():
    sizes, w, caps = {"a": 100.0, "b": 10.0, "c": 50.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 2}
    t = M.water_fill(sizes, w, caps, 120)
    assert t["b"] == 30 and t["a"] == pytest.approx(90 * 5 / 7) and sum(t.values()) == pytest.approx(120)
    assert M.water_fill(sizes, w, caps, 1e9) == {"a": 100.0, "b": 30.0, "c": 100.0}
    assert M.water_fill({}, w, caps, 10) == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert M.reachable_total(sizes, w, caps) == pytest.approx(100.0)


def test_mix_reaches_shares(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, "odd").otherwise("big").alias("source"), (F.col("id") % 7 + 1).alias("tokens"))
    docs = docs.unionByName(spark.createDataFrame([(9999, None, 5), (9998, "big", None)], "doc_id bigint, source string, tokens bigint"))
    t = spark.createDataFrame([("small", 0.4, 3), ("big", 0.5, 1), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out, shares = M.mix(docs, t, total="reachable")
    got = {r.source: r for r in shares.collect()}
    assert abs(got["small"].reached_share - 0.4 / 0.9) < 0.01 and abs(got["big"].reached_share - 0.5 / 0.9) < 0.01 and got["gone"].used_tokens == 0
    assert {r.source for r in out.select("source").distinct().collect()} == {"small", "big"}
    assert all(r.most_copies <= r.max_repeats for r in got.values())
    out, shares = M.mix(docs, t)  # at the size of the corpus
    got = {r.source: r for r in shares.collect()}
    assert got["small"].most_copies == 3 and got["small"].clamped and out.where("copies > 3").count() == 0
    assert got["big"].used_tokens > 0.99 * min(got["big"].available_tokens, got["big"].used_tokens + 1) and got["small"].used_tokens == 3 * got["small"].available_tokens
    again = M.mix(docs, t)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    none, s = M.mix(docs.limit(0), t)
    assert none.count() == 0 and {r.reached_share for r in s.collect()} == {0.0}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "é" * 20_000)], "k bigint, t string")
    got = {r.k: r.tokens for r in tokens.sized(df, "k", "t", []).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1 and got[5] > 1000
