"""Records of the evaluation splits that stand, exactly or almost, in the training split.

Texts are word sequences.  The word n-gram hashes of the evaluation texts are made first, the training
texts are scanned for hits, and only hits go on.  No near pair is lost: two edits touch at most 2n of a
text's n-grams, so any 2n+1 of them (the rarest in training are taken) have one that stands in training.
A candidate pair stays if the containment of the evaluation text in the training text is as high as two edits
leave it; an exact word edit distance decides.

Texts with fewer than 2n+1 n-grams meet by what is left of them after dropping up to two words.  Any two texts of at
most two words are near; they are never paired here, only their members are named in the last step.

Equal word sequences are one class throughout.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import heavy_keys, salted_join, union_all
from ..workspace import Workspace

#: Words in an n-gram for texts of LONG words and more; shorter texts meet by their remains.
GRAM = 3
EDITS = 2
LONG = GRAM * EDITS + GRAM  # the least length with 2n+1 n-grams
#: Ways in which the members of texts of at most EDITS words are spread when they are named.
TINY_WAYS = 16


def words(text: Column) -> Column:
    """Unbroken runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _grams(w: Column) -> Column:
    ix = F.when(F.size(w) >= GRAM, F.sequence(F.lit(0), F.size(w) - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.transform(ix, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]))


def _as_letters(w: Column) -> Column:
    """Each word as one code point (by hash), so that the built-in edit distance counts words.

    Collisions can only make texts look nearer; the exact check follows.
    """
    code = F.transform(w, lambda x: F.lpad(F.hex(F.pmod(F.xxhash64(x), F.lit(1_048_576)) + 65_536), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _remains(w: Column) -> Column:
    """Hashes of what is left of a short text after dropping up to two words; nothing left gives no hash."""
    each = F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def without(i: Column, j: Column) -> Column:
        return F.array_join(F.transform(F.filter(each, lambda e: (e["i"] != i) & (e["i"] != j)), lambda e: e["x"]), " ")

    ends = F.sequence(F.lit(0), F.size(w))  # the place after the last word drops nothing
    texts = F.flatten(F.transform(ends, lambda i: F.transform(F.filter(ends, lambda j: j >= i), lambda j: without(i, j))))
    return F.array_distinct(F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.xxhash64(t)))


def within(a: list[str], b: list[str], k: int) -> bool:
    """Is the word edit distance of two sequences at most ``k``?"""
    if abs(len(a) - len(b)) > k:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > 3 * k + 1 and len(b) > 3 * k + 1 and len(set(a) & set(b)) == 0:
        return False
    row = list(range(len(b) + 1))
    for x, wa in enumerate(a, 1):
        prev, row[0] = row[0], x
        for y in range(1, len(b) + 1):
            prev, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, prev + (wa != b[y - 1]))
        if min(row) > k:
            return False
    return row[-1] <= k


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within(x.split(), y.split(), EDITS) for x, y in zip(a, b)])


def _rarest(keys: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """The ``n`` keys of each class with the lowest training frequency; those that training lacks count but cannot hit."""
    r = keys.join(frequency, "g", "left").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("ks"))
    return r.select("k", "n", F.explode(F.slice("ks", 1, n)).alias("x")).where("x.f > 0").select("k", "n", "x.g")


def _split(seq: Column) -> Column:
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.split(seq, " "))


def _met(train_keys: DataFrame, eval_keys: DataFrame, heavy: list) -> DataFrame:
    """(ke, kt): classes that share a key and differ in length as two edits allow; hot keys of training are spread."""
    e = eval_keys.select(F.col("k").alias("ke"), "n", "g")
    j = salted_join(train_keys.select(F.col("k").alias("kt"), F.col("n").alias("m"), "g"), e, ["g"], "inner", heavy, F.col("kt"))
    return j.where((F.abs(F.col("n") - F.col("m")) <= EDITS) & (F.greatest("n", "m") > EDITS)).select("ke", "kt")


def overlaps(evaluation: DataFrame, training: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(class pairs, members): pairs (ce, ct, containment, same) of evaluation and training classes within EDITS word edits.

    ``evaluation`` has (tab, id, text), ``training`` (id, text).  Members are (ev, tab, id, c, tiny).  A null text is
    in no class; a text without words is a class like any other.  Pairs of two texts of at most EDITS words (tiny)
    are all near and left out: word count alone tells them.  ``containment`` is the share of the evaluation text's
    distinct n-grams that the training text has; texts shorter than an n-gram have 1 if equal, else 0.
    """
    t = F.col("text")
    rows = evaluation.select(F.lit(True).alias("ev"), "tab", "id", t).unionByName(training.select(F.lit(False).alias("ev"), F.lit("").alias("tab"), "id", t)).where("text is not null")
    rows = rows.select("ev", "tab", "id", words(t).alias("w")).select("ev", "tab", "id", F.array_join("w", " ").alias("seq"), (F.size("w") <= EDITS).alias("tiny"))
    rows = ws.keep(rows.withColumn("c", F.unhex(F.md5("seq"))), "rows")
    cl = rows.groupBy("c", "seq").agg(F.max("ev").alias("ev"), F.max(~F.col("ev")).alias("tr"))  # fixed-width buffers: a hash aggregation
    cl = ws.keep(cl.select(F.monotonically_increasing_id().alias("k"), "c", "seq", F.size(_split(F.col("seq"))).alias("n"), "ev", "tr"), "classes")
    ev, tr = cl.where("ev"), cl.where("tr")

    def gram_rows(d: DataFrame, least: int) -> DataFrame:
        w = d.where(F.col("n") >= least).select("k", "n", _split(F.col("seq")).alias("w"))  # split once, read in every n-gram
        return w.select("k", "n", F.explode(F.array_distinct(_grams(F.col("w")))).alias("g"))

    # texts of LONG words: the hashes of evaluation first, then the scan of training; its hits alone are written
    eg = ws.keep(gram_rows(ev, LONG), "evaluation-grams")
    asked = ws.keep(eg.select("g").distinct(), "asked")
    hits = ws.keep(gram_rows(tr, LONG - EDITS).join(asked, "g", "left_semi"), "hits")
    tf = ws.keep(hits.groupBy("g").agg(F.count(F.lit(1)).alias("f")), "frequency")
    total = tf.agg(F.sum("f")).first()[0] or 0
    heavy = [r[0] for r in tf.where(F.col("f") >= max(20_000, 0.02 * total)).select("g").collect()]  # at most 50
    cand = [_met(hits, _rarest(eg, tf, GRAM * EDITS + 1), heavy)]

    # shorter ones: two texts within two edits have a common remainder
    def short(d: DataFrame, hi: int) -> DataFrame:
        w = d.where(F.col("n").between(1, hi)).select("k", "n", _split(F.col("seq")).alias("w"))
        return w.select("k", "n", F.explode(_remains(F.col("w"))).alias("g"))

    es, ts = short(ev, LONG - 1), ws.keep(short(tr, LONG - 1 + EDITS), "remains")
    cand.append(_met(ts, es, heavy_keys(ts, "g")))
    cand = union_all(cand).distinct()

    e = ev.select(F.col("k").alias("ke"), F.col("c").alias("ce"), F.col("seq").alias("se"))
    r = tr.select(F.col("k").alias("kt"), F.col("c").alias("ct"), F.col("seq").alias("st"))
    p = cand.join(e, "ke").join(r, "kt").select("ce", "ct", "se", "st", _split(F.col("se")).alias("we"), _split(F.col("st")).alias("wt"))
    p = p.withColumn("ge", F.array_distinct(_grams(F.col("we")))).withColumn("gt", F.array_distinct(_grams(F.col("wt")))).withColumn("shared", F.size(F.array_intersect("ge", "gt")))
    p = p.where(F.col("shared") >= F.size("ge") - GRAM * EDITS)  # an edit costs a text at most GRAM of its n-grams
    p = p.where(F.levenshtein(_as_letters(F.col("we")), _as_letters(F.col("wt")), EDITS) >= 0).where(_near("se", "st"))
    same = F.col("ce") == F.col("ct")
    contained = F.when(F.size("ge") > 0, F.col("shared") / F.size("ge")).otherwise(same.cast("double"))
    return ws.keep(p.select("ce", "ct", contained.alias("containment"), same.alias("same")), "pairs"), rows.select("ev", "tab", "id", "c", "tiny")


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return members.where("ev").select("tab", "id", F.col("c").alias("ce"), "tiny"), members.where("not ev").select(F.col("id").alias("train_id"), F.col("c").alias("ct"), "tiny")


def overlap_pairs(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(tab, id, train_id, containment, same): every evaluation record with every training record near it.

    The result names pairs of rows, so classes are expanded here and nowhere else; a class that holds many rows on
    either side is spread.
    """
    ws = Workspace(evaluation.sparkSession, "split-overlap")
    pairs, members = overlaps(evaluation, training, ws)
    e, t = _sides(members)
    one = salted_join(e.drop("tiny"), pairs, ["ce"], "inner", heavy_keys(e, "ce"), F.col("id"))
    out = salted_join(t.drop("tiny"), one, ["ct"], "inner", heavy_keys(t, "ct"), F.col("train_id")).select("tab", "id", "train_id", "containment", "same")
    te = e.where("tiny").withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(TINY_WAYS - 1))))
    tt = t.where("tiny").withColumn("way", F.pmod(F.xxhash64("train_id"), F.lit(TINY_WAYS)).cast("int"))
    same = F.col("ce") == F.col("ct")
    return out.unionByName(te.drop("tiny").join(tt.drop("tiny"), "way").select("tab", "id", "train_id", same.cast("double").alias("containment"), same.alias("same")))


def overlapping_records(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(tab, id, n_classes, exact, containment): one row per evaluation record that overlaps; no pair is expanded."""
    ws = Workspace(evaluation.sparkSession, "split-overlap")
    pairs, members = overlaps(evaluation, training, ws)
    e, t = _sides(members)
    per = pairs.groupBy("ce").agg(F.count(F.lit(1)).alias("n_classes"), F.max("same").alias("exact"), F.max("containment").alias("containment"))
    tiny = t.where("tiny").select("ct").distinct()
    n_tiny = tiny.count()
    out = salted_join(e, per, ["ce"], "left", heavy_keys(e, "ce"), F.col("id"))
    if n_tiny:  # a tiny text is near each of the tiny classes of training, the equal one among them
        out = out.join(tiny.select(F.col("ct").alias("ce"), F.lit(True).alias("_equal")), "ce", "left")
        equal, more = F.coalesce("_equal", F.lit(False)) & F.col("tiny"), F.when(F.col("tiny"), n_tiny).otherwise(0)
        out = out.withColumn("exact", F.coalesce("exact", F.when(F.col("tiny"), False)) | equal).withColumn("containment", F.greatest("containment", F.when(F.col("tiny"), equal.cast("double"))))
        out = out.withColumn("n_classes", F.coalesce("n_classes", F.when(F.col("tiny"), 0)) + more)
    return out.where("n_classes is not null").select("tab", "id", "n_classes", "exact", "containment")
