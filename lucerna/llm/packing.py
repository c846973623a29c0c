"""Filling containers of fixed capacity with items, by Karmarkar-Karp multiway differencing.

Items are spread over blocks of bounded size by a hash and each block is differenced on its own.  Near-equal
windows share a block's slack evenly, so in the first round a block keeps only as much as fills a whole
number of windows nearly to the brim and carries the rest over; if a window still exceeds the capacity, less is
kept.  The second round packs what all blocks carried over into the fewest windows, one more as long as one
exceeds the capacity.
"""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Shares of the capacity a first-round window may be filled to, tried in turn.
FILLS = (*(0.9975 - 0.0025 * i for i in range(28)), 0.9, 0.85)
#: Blocks that share a task, and the most tasks of a round; beyond that more blocks share one.
BLOCKS_A_TASK, MOST_TASKS = 6, 20_000

#: Bits of an entry's group number; above them stands the sum of its window.
SHIFT = 32

_WINDOWS = "container string, block long, item string, piece int, size long, win int"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each item: the two partial partitions with the widest imbalance are merged, largest window
    with smallest, until one is left.

    A partial partition lists only its windows that hold items, ascending, as ``sum << SHIFT | group``; the others are
    empty.  ``floor`` is what was taken from all its sums so that the smallest window counts 0.  A merge with a single
    item, the usual one, moves one entry; groups of items that share a window form a binary tree.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    if n <= k:
        return np.arange(n, dtype=np.int64)
    mask = (1 << SHIFT) - 1
    joined: list[tuple[int, int]] = []  # group n + i holds the two groups joined[i]
    parts: dict[int, tuple[list[int], int]] = {i: ([int(s) << SHIFT | i], 0) for i, s in enumerate(sizes)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        (a, fa), (b, fb) = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        if len(a) < len(b):
            (a, fa), (b, fb) = (b, fb), (a, fa)
        both = len(a) + len(b) - k  # windows that hold items of either side
        if len(b) == 1:
            entry, floor = b[0] - (fb - fa << SHIFT), fa
            if both > 0:
                least = a.pop(0)
                joined.append((least & mask, entry & mask))
                entry = ((least >> SHIFT) + (entry >> SHIFT) - fa) << SHIFT | n + len(joined) - 1
            insort(a, entry)
        else:
            pair = max(0, both)
            low_a, low_b = a[:pair], b[:pair][::-1]  # the smallest windows of one side meet the largest that remain of the other
            floor, down = 0, (fa << SHIFT, fb << SHIFT)
            new = [x - down[0] for x in a[pair:]] + [x - down[1] for x in b[pair:]]
            for x, y in zip(low_a, low_b):
                joined.append((x & mask, y & mask))
                new.append(((x >> SHIFT) - fa + (y >> SHIFT) - fb) << SHIFT | n + len(joined) - 1)
            new.sort()
            a = new
        if len(a) == k:
            floor = a[0] >> SHIFT
        parts[name] = (a, floor)
        heapq.heappush(heap, (floor - (a[-1] >> SHIFT), name))
        name += 1
    (last, _), = parts.values()
    out = np.zeros(n, dtype=np.int64)
    for w, entry in enumerate(reversed(last)):
        todo = [entry & mask]
        while todo:
            g = todo.pop()
            if g < n:
                out[g] = w
            else:
                todo += joined[g - n]
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; the window count starts at the least possible and rises whenever one overflows."""
    if len(sizes) == 0:
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = difference(sizes, k)
        fill = np.bincount(w, weights=sizes, minlength=k)
        if fill.max() <= capacity:
            return w
        k += max(1, int((fill > capacity).sum()) // 64)


def pack_to_the_brim(sizes: np.ndarray, capacity: int, fills: tuple[float, ...] = FILLS) -> np.ndarray:
    """Window of each item, -1 for items carried over: windows near-equal and filled to about the highest of ``fills``
    that differencing reaches without exceeding the capacity, found by halving the list."""
    none = np.full(len(sizes), -1, dtype=np.int64)
    total = int(sizes.sum())
    order = np.random.default_rng(len(sizes)).permutation(len(sizes))  # a fair mix of sizes stays
    run = np.cumsum(sizes[order])

    def at(f: float) -> np.ndarray | None:
        k = int(total / (capacity * f))
        kept = np.sort(order[: int(np.searchsorted(run, k * capacity * f, side="right"))])
        w = difference(sizes[kept], k)
        if k < 1 or np.bincount(w, weights=sizes[kept], minlength=k).max() > capacity:
            return None
        out = none.copy()
        out[kept] = w
        return out

    best, lo, hi = none, 0, len(fills)
    while lo < hi:
        mid = (lo + hi) // 2 if lo else min(hi - 1, 3)  # most blocks reach one of the first
        found = at(fills[mid])
        if found is None:
            lo = mid + 1
        else:
            best, hi = found, mid
    return best


def _pack_block(final: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, sort_keys=[("size", "descending"), ("item", "ascending"), ("piece", "ascending")]))
        sizes, capacity = block["size"].to_numpy(), block["capacity"][0].as_py()
        w = pack(sizes, capacity) if final else pack_to_the_brim(sizes, capacity)
        return block.select(["container", "block", "item", "piece", "size"]).append_column("win", pa.array(w, pa.int32()))

    return run


def fill_containers(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens", block_items: int = 800) -> DataFrame:
    """(container, window_id, key, piece, size): every item of every container size in exactly one window.

    ``containers`` is (container, capacity_tokens), a small dimension table.  An item larger than the capacity, and no
    other, is cut into full pieces and a rest (piece 0 is a whole item, pieces count from 1).  Items of size null,
    zero or less take no space and are left out; capacities of zero or less hold nothing.
    """
    spark = items.sparkSession
    ws = Workspace(spark, "packing")
    caps = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct().collect()
    it = ws.keep(items.select(F.col(key).cast("string").alias("item"), F.col(size).cast("long").alias("size")).where("size > 0 and item is not null"), "items")
    count = it.count()
    blocks = max(1, -(-count // block_items))
    # one row per item and container size: the sizes are a fixed list
    pieces = it.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).alias("capacity")) for r in caps]))).select("item", "size", "c.*") if caps else None
    if pieces is None:
        return spark.createDataFrame([], f"container string, window_id string, {key} string, piece int, size long")
    full = F.floor((F.col("size") - 1) / F.col("capacity")).cast("int")
    cut = F.when(F.col("size") <= F.col("capacity"), F.array(F.struct(F.lit(0).alias("piece"), F.col("size").alias("part")))).otherwise(
        F.transform(F.sequence(F.lit(1), full + 1), lambda p: F.struct(p.alias("piece"), F.when(p <= full, F.col("capacity")).otherwise(F.col("size") - F.col("capacity") * full).alias("part")))
    )
    pieces = pieces.select("container", "capacity", "item", F.explode(cut).alias("x")).select("container", "capacity", "item", "x.piece", F.col("x.part").alias("size"))
    whole = pieces.where("size = capacity").select("container", F.concat_ws("-", F.lit("full"), "item", "piece").alias("window_id"), "item", "piece", "size")
    rest = pieces.where("size < capacity")

    def run(df: DataFrame, n: int, name: str, final: bool) -> DataFrame:
        b = df.withColumn("block", F.pmod(F.xxhash64("item", "piece", F.lit(name)), F.lit(n)))
        # the work is in the blocks, not in their few bytes: enough partitions for all cores, a few blocks in each
        tasks = max(1, min(MOST_TASKS, n * len(caps) // BLOCKS_A_TASK))
        b = b.repartition(tasks, "container", "block")
        return ws.keep(b.groupBy("container", "block").applyInArrow(_pack_block(final), _WINDOWS), name)

    first = run(rest, blocks, "first", False)
    capacity = F.create_map(*[F.lit(x) for r in caps for x in (r["container"], r["capacity"])])[F.col("container")]
    done, left = first.where("win >= 0"), first.where("win < 0").select("container", capacity.alias("capacity"), "item", "piece", "size")
    second = run(left, max(1, -(-left.count() // (block_items * len(caps)))), "second", True)

    def named(df: DataFrame, stage: str) -> DataFrame:
        return df.select("container", F.concat_ws("-", F.lit(stage), "block", "win").alias("window_id"), "item", "piece", "size")

    out = whole.unionByName(named(done, "a")).unionByName(named(second, "b"))
    return out.withColumnRenamed("item", key)


def summary(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """Windows, tokens and unused share per container size."""
    w = filled.groupBy("container", "window_id").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("n"))
    s = w.groupBy("container").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.sum("n").alias("n_pieces"))
    cap = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity"))
    s = s.join(F.broadcast(cap.distinct()), "container")  # one row per container size, a fixed list
    return s.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("n_windows") * F.col("capacity")), 6))
