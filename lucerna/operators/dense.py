"""Dense retrieval: exact top-k by blocks of queries and corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k


class Embedder(Protocol):
    """Anything that turns texts into vectors; loaded once per worker."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic offline default: hashed word counts, L2-normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(key, embedding): null texts are skipped; the model lives in the worker for all batches of a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                x = pdf.iloc[i : i + batch]
                yield pd.DataFrame({key: x[key], "embedding": [v.astype("float32").tolist() for v in embedder.encode(list(x[text]))]})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def missing_embeddings(corpus: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows a cache keyed by content does not hold yet."""
    return corpus.join(cache.select(key), key, "left_anti")


#: Bytes of query vectors up to which they travel with the tasks; more are met block by block.
QUERY_BYTES = 64 << 20


def _best(q_ids, q_vecs, c_ids, c_vecs, k: int, drop_self: bool) -> pd.DataFrame:
    """The best ``k`` of a block of the corpus for every query, all ties of the last place with them."""
    s = np.round(q_vecs @ c_vecs.T, 8)
    if drop_self:
        s[np.equal.outer(q_ids, c_ids)] = -np.inf
    n = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    row, col = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
    return pd.DataFrame({"q": q_ids[row], "c": c_ids[col], "score": s[row, col]})


def _by_dimension(ids, vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (ids, matrix); empty vectors are left out."""
    size = np.array([len(v) for v in vectors], dtype=int)
    ids = np.asarray(ids)
    return {int(d): (ids[size == d], np.stack([v for v, n in zip(vectors, size) if n == d]).astype("float64")) for d in set(size) - {0}}


def dense_topk(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 20, query_block: int = 2048, corpus_block: int = 20_000, drop_self: bool = True, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(q, rank, key, score): exact inner-product neighbours, rounded to 8 places, ties to the smaller key.

    Queries of at most ``query_bytes`` in all travel with the tasks and the corpus streams past them where it lies: a
    batch is one matrix product, and only ``k`` rows per query and batch leave it.  More queries meet the corpus in
    blocks, each pair of blocks once.  Vectors that are null or of another length than the query's match nothing.
    """
    v = F.col(vector)
    kind = dict(corpus.dtypes)[key]
    qs = queries.where(v.isNotNull()).select(F.col(key).alias("q"), v.alias("v"))
    held = qs.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 16), F.lit(0))).first()[0]
    out = f"q {kind}, c {kind}, score double"
    if held <= query_bytes:
        rows = qs.collect()  # at most query_bytes
        mine = _by_dimension([r[0] for r in rows], [r[1] for r in rows])

        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for d, (ids, vecs) in _by_dimension(pdf["c"].to_numpy(), list(pdf["v"])).items():
                    if d in mine:
                        yield _best(*mine[d], ids, vecs, k, drop_self)

        best = corpus.where(v.isNotNull()).select(F.col(key).alias("c"), v.alias("v")).mapInPandas(scan, out)
        return top_k(best, "q", "c", "score", k).select("q", "rank", F.col("c").alias(key), "score")
    nq, nc = qs.count(), corpus.count()
    qb, cb = max(1, -(-nq // query_block)), max(1, -(-nc // corpus_block))
    qs = qs.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(qb))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    cs = corpus.where(v.isNotNull()).select(F.col(key).alias("c"), v.alias("v"), F.pmod(F.xxhash64(key), F.lit(cb)).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _by_dimension(a["q"].to_numpy(), list(a["v"])), _by_dimension(b["c"].to_numpy(), list(b["v"]))
        found = [_best(*x[d], *y[d], k, drop_self) for d in x if d in y]
        return pd.concat(found) if found else pd.DataFrame({"q": [], "c": [], "score": []})

    best = qs.groupBy("qb", "cb").cogroup(cs.groupBy("qb", "cb")).applyInPandas(block, out)
    return top_k(best, "q", "c", "score", k).select("q", "rank", F.col("c").alias(key), "score")
