"""Lexical retrieval: term tables and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..workspace import Workspace
from .skew import union_all

K1, B = 1.5, 0.75


def postings(corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """A10: (doc, term, tf, dl, first): with the length of the document and whether the term is its first.

    Documents without a term have no row; null texts have none.
    """
    d = corpus.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("ts")).select("doc", F.size("ts").alias("dl"), F.posexplode("ts").alias("p", "term"))
    return d.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.max(F.col("p") == 0).alias("first"))


def top_k(scored: DataFrame, by: str, item: str, score: str, k: int) -> DataFrame:
    """``rank`` within ``by`` by score, ties by item; the group limit runs before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Weights of asked terms, (query, term), that travel with the tasks at a time: some 20 MB.
ASKED_ROWS = 500_000


def _first_k(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, of equal ones the earlier places; in the order of places."""
    if len(score) <= k:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - k)[len(score) - k]
    above = score > edge
    tied = np.flatnonzero(score == edge)[: k - np.count_nonzero(above)]
    above[tied] = True
    return np.flatnonzero(above)


class _Block:
    """Postings of the asked terms in a block of documents, which are numbered in the order of their keys."""

    def __init__(self, docs: pa.Array, dl: np.ndarray, at: np.ndarray, term: np.ndarray, n_terms: int, avgdl: float):
        order = pc.sort_indices(docs, null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype="int64")
        place[order] = np.arange(len(order))
        self.docs, dl = docs.take(pa.array(order)), dl[order]
        keys, tf = np.unique(term * np.int64(len(order)) + place[at], return_counts=True)
        t, self.at = np.divmod(keys, np.int64(len(order)))
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[self.at] / avgdl))
        self.start = np.searchsorted(t, np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, t, self.part)
        self.sums = np.zeros(len(order))

    def best(self, terms: np.ndarray, w: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best documents that reach ``bar``.

        Terms come by falling weight, and each document adds them up in that order.  Once what the remaining ones can
        add at most stays below the k-th best sum, a document without any of the earlier terms is out, and the
        remaining ones are looked up only in the documents that can still get there.
        """
        most = w * self.most[terms]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        if rest[0] < bar - SLACK:
            return NO_PLACES, NO_SCORES
        sums, n, seen = self.sums, len(self.sums), 0
        sums[:] = 0.0
        for j, t in enumerate(terms):
            a, b = self.start[t], self.start[t + 1]
            if a == b:
                continue
            if (b - a) * 16 > n and seen >= k:
                got = sums[sums > 0]
                if len(got) >= k:
                    bar = max(bar, np.partition(got, len(got) - k)[len(got) - k] - SLACK)
            if rest[j] < bar - SLACK:
                break
            sums[self.at[a:b]] += w[j] * self.part[a:b]
            seen += b - a
        else:
            j = len(terms)
        places = np.flatnonzero(sums)
        for i in range(j, len(terms)):
            places = places[sums[places] + rest[i] >= bar - SLACK]
            a, b = self.start[terms[i]], self.start[terms[i] + 1]
            if a < b and len(places):
                x = np.minimum(np.searchsorted(self.at[a:b], places), b - a - 1) + a
                has = self.at[x] == places
                sums[places[has]] += w[i] * self.part[x[has]]
        score = np.floor(sums[places] * 1e8 + 0.5) / 1e8
        keep = score >= bar - SLACK
        places, score = places[keep], score[keep]
        keep = _first_k(score, k)
        return places[keep], score[keep]


#: More than rounding to 8 places can move a score.
SLACK = 1e-7
NO_PLACES, NO_SCORES = np.zeros(0, dtype="int64"), np.zeros(0)


def _scan(weights: pa.Table, avgdl: float, k: int, block: int):
    """For ``mapInArrow``: (doc, ts, dl) past the weights (q, term, w), out come at most ``k`` documents per query and block."""
    weights = weights.combine_chunks()
    asked = pc.unique(weights["term"])
    q = weights["q"].combine_chunks().dictionary_encode("encode")
    names, number = q.dictionary, q.indices.to_numpy()
    term, w = pc.index_in(weights["term"], value_set=asked).to_numpy(), weights["w"].to_numpy()
    by = np.lexsort((term, -w, number))
    term, w = term[by].astype("int64"), w[by]
    start = np.searchsorted(number[by], np.arange(len(names) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.zeros((len(names), k))  # of this task so far; the lowest first
        for x in _blocks(batches, asked, block, avgdl):
            at, places, scores = [], [], []
            for i in range(len(names)):
                p, s = x.best(term[start[i] : start[i + 1]], w[start[i] : start[i + 1]], k, high[i, 0])
                if len(p):
                    high[i] = np.sort(np.partition(np.concatenate([high[i], s]), len(s))[len(s) :])
                    at.append(np.full(len(p), i))
                    places.append(p)
                    scores.append(s)
            if at:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(at))), x.docs.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], ["q", "doc", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], asked: pa.Array, block: int, avgdl: float) -> Iterator[_Block]:
    held, n = [], 0

    def made() -> _Block:
        docs, dl, at, term = zip(*held)
        shift = np.cumsum([0, *map(len, docs)])
        return _Block(pa.concat_arrays(docs), np.concatenate(dl), np.concatenate([a + s for a, s in zip(at, shift)]), np.concatenate(term), len(asked), avgdl)

    for b in batches:
        term = pc.fill_null(pc.index_in(pc.list_flatten(b["ts"]), value_set=asked), -1).to_numpy().astype("int64")
        at, known = pc.list_parent_indices(b["ts"]).to_numpy(), term >= 0
        held.append((b["doc"], b["dl"].to_numpy(), at[known], term[known]))
        n += b.num_rows
        if n >= block:
            yield made()
            held, n = [], 0
    if n:
        yield made()


def bm25_topk(queries: DataFrame, corpus: DataFrame, q: str, qtext: str, doc: str, text: str, k: int = 20, asked_rows: int = ASKED_ROWS, block: int = 30_000) -> DataFrame:
    """(q, rank, doc, score): the ``k`` best documents of each query.

    idf = ln(1 + (N - df + .5)/(df + .5)); scores are rounded to 8 places before they are ranked, ties go to the
    smaller document.  N counts documents with a term.  Queries without a known term get no row.  ``corpus`` has one
    row for each document; its terms are written once, for the two figures of the corpus, for frequencies and for
    scores.  Pairs of a query and a document never become rows: the weights of the queries' terms, ``asked_rows`` at a
    time, travel with the tasks, the documents stream past them in blocks, and ``k`` rows per query and block leave.
    """
    ws = Workspace(corpus.sparkSession, "bm25")
    d = corpus.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("ts")).select("doc", "ts", F.size("ts").alias("dl")).where("dl > 0")
    d = ws.keep(d, "documents")
    n, total = d.agg(F.count(F.lit(1)), F.sum("dl")).first()  # two numbers
    avgdl = total / n if n else 1.0
    qt = queries.select(F.col(q).alias("q"), F.explode(tokens(F.col(qtext))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = d.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = ws.keep(qt.join(df, "term").select("q", "term", (F.col("qtf") * idf).alias("w")), "weights")
    parts = max(1, -(-weights.count() // asked_rows))
    out = f"q {dict(queries.dtypes)[q]}, doc {dict(corpus.dtypes)[doc]}, score double"

    def best(some: DataFrame) -> DataFrame:
        return top_k(d.mapInArrow(_scan(some.toArrow(), avgdl, k, block), out), "q", "doc", "score", k)  # about asked_rows

    if parts == 1:
        found = best(weights)
    else:
        found = union_all([ws.keep(best(weights.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)), f"best-{i}") for i in range(parts)])
    return found.select(F.col("q").alias(q), "rank", F.col("doc").alias(doc), "score")
