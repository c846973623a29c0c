"""Bootstrap intervals."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Resamples, seed and the places of the bounds in the sorted resample means.
RESAMPLES, SEED, LOWER, UPPER = 10_000, 20260726, 0.025, 0.975


#: Weight 0, 1, 2 ... of a draw of 16 bits: the bounds of a Poisson distribution of mean 1.
POISSON = tuple(round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8))
_DRAWS = 8  # draws of 16 bits in one digest


def poisson_means(df: DataFrame, key: str, value: str, resamples: int = RESAMPLES, seed: int = SEED, stratum: str | None = None) -> DataFrame:
    """(b, mean): resample means in which every row has a Poisson weight from a hash of its key.

    Each row draws its own weights, so rows need no numbers and no order; sums are combined in the map tasks and one row
    per resample and stratum is shuffled.  With strata the mean is that of the strata's means.  Null values do not
    count; a resample that draws no row of a stratum leaves the stratum out.
    """
    s = F.col(stratum) if stratum else F.lit("all")
    v = df.where(F.col(value).isNotNull()).select(s.alias("s"), F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = v.repartition(parts, "k")  # the work is in the draws: a small table is spread before they are made
    each = v.select("s", "k", "v", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // _DRAWS) - 1))).alias("c"))
    each = each.withColumn("h", F.md5(F.concat_ws("|", "c", "k", F.lit(seed))))
    long = lambda at, n: F.conv(F.substr("h", F.lit(at), F.lit(n)), 16, 10).cast("long")
    each = each.select("s", "v", "c", long(1, 12).alias("h0"), long(13, 12).alias("h1"), long(25, 8).alias("h2"))
    cut = [(h, shift) for h, n in (("h0", 3), ("h1", 3), ("h2", 2)) for shift in range(16 * (n - 1), -1, -16)]  # hexadecimal digits in fours, left to right
    bits = F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright(h, shift).bitwiseAND(0xFFFF).cast("int").alias("u")) for j, (h, shift) in enumerate(cut)])
    d = each.select("s", "v", "c", F.explode(bits).alias("d")).select("s", "v", (F.col("c") * _DRAWS + F.col("d.j")).alias("b"), F.col("d.u").alias("u"))
    d = d.withColumn("w", reduce(lambda x, y: x + y, [(F.col("u") >= t).cast("int") for t in POISSON])).where(f"w > 0 and b < {resamples}")
    per = d.groupBy("s", "b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return per.groupBy("b").agg(F.round(F.avg("m"), 10).alias("mean"))


def interval(means: DataFrame) -> DataFrame:
    """(n, mean, lower, upper, win_share): bounds are the sorted means at places int(.025 n) and int(.975 n), from 0.

    ``means`` has one row per resample, a fixed number.
    """
    r = means.withColumn("r", F.row_number().over(Window.orderBy("mean")) - 1)
    n = means.count()
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.max(F.when(F.col("r") == int(LOWER * n), F.col("mean"))), 6).alias("lower"),
        F.round(F.max(F.when(F.col("r") == int(UPPER * n), F.col("mean"))), 6).alias("upper"), F.round(F.avg((F.col("mean") > 0).cast("double")), 6).alias("win_share"),
    )


def replay(values: list[float], resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float, float]:
    """The exact seeded replay over a small score list: (lower, upper, share of means above 0)."""
    rng = random.Random(seed)
    n = len(values)
    if n == 0:
        return (float("nan"),) * 3
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[int(LOWER * resamples)], means[int(UPPER * resamples)], sum(m > 0 for m in means) / resamples


def replay_means(values, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """The resample means of ``replay``: the same draws from the same generator, many at a time."""
    v = np.asarray(values, dtype=float)
    n = len(v)
    *key, pos = random.Random(seed).getstate()[1]
    g = np.random.MT19937()
    g.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, dtype=np.uint32), "pos": pos}}
    means, drawn = np.empty(resamples), np.empty(0, dtype=np.uint64)
    for b in range(resamples):
        while len(drawn) < n:  # randrange: the upper bits of a 32-bit word, drawn again if not below n
            more = g.random_raw(max(1 << 16, 2 * n)) >> np.uint64(32 - n.bit_length())
            drawn = np.concatenate([drawn, more[more < n]])
        means[b] = v[drawn[:n].astype(np.int64)].sum() / n
        drawn = drawn[n:]
    return means


def replay_interval(df: DataFrame, key: str, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """A30 as ``interval`` shows it: the exact replay over the scores in the order of ``key``, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sort(replay_means(pdf.sort_values("k", kind="stable")["v"], resamples, seed))
        row = [m.mean(), m[int(LOWER * resamples)], m[int(UPPER * resamples)], (m > 0).mean()]
        return pd.DataFrame([[resamples, *[round(float(x), 6) for x in row]]], columns=["n", "mean", "lower", "upper", "win_share"])

    d = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    return d.groupBy("g").applyInPandas(run, "n long, mean double, lower double, upper double, win_share double")
