"""Splits that keep related records together.

Components are kept from batch to batch, in tables that only grow.  Records are tied through keys; each key's
smallest record is its hub, so a key in a third of all rows is a star and never a clique.  The graph
is contracted with pointer jumping: every node points to its smallest neighbour, pointers are
followed once more, the edges are rewritten to the pointed-to labels, and what remains is
contracted again until no edge is left.

Components that have a split keep it; new ones fill the deficits of the splits; a merge of
components with different splits is quarantined and its older records are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, salted_join
from ..workspace import Workspace

QUARANTINE = "quarantine"


#: Rows below which no key is worth spreading; a table with fewer is not even counted by key.
LEAST = 20_000


def _heavy(counted: DataFrame, key: str, share: float = 0.02, least: int = LEAST) -> list:
    """Keys of a counted table (key, n) that hold ``share`` of the sum: at most 1/share of them."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counted.where(F.col("n") >= max(least, share * total)).select(key).collect()]


def contract(edges: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node that has an edge, the smallest node of its connected component.

    ``edges`` is (u, v), any direction, repeats and loops allowed.  Each round keeps its pointer table; they are
    composed from the last, smallest one backwards.
    """
    e = ws.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")
    tables: list[DataFrame] = []
    nodes: list[int] = []
    for k in range(most_rounds):
        n_edges = e.count()  # from the files' footers
        if n_edges == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = ws.keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("p"), "n"), f"p{k}")
        hot = _heavy(p.select("u", "n"), "u") if n_edges >= LEAST else []
        n_nodes = p.count()
        aimed = p.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        f = ws.keep(salted_join(p.select("u", "p"), up, ["p"], "inner", _heavy(aimed, "p") if n_nodes >= LEAST else [], F.col("u")).select("u", F.col("pp").alias("f")), f"f{k}")
        tables.append(f)
        nodes.append(n_nodes)
        fu, fv = f.select("u", F.col("f").alias("fu")), f.select(F.col("u").alias("v"), F.col("f").alias("fv"))
        moved = salted_join(salted_join(e, fu, ["u"], "inner", hot, F.col("v")), fv, ["v"], "inner", hot, F.col("u"))
        nxt = moved.where("fu <> fv").select(F.greatest("fu", "fv").alias("u"), F.least("fu", "fv").alias("v")).distinct()
        e = ws.keep(nxt, f"e{k + 1}")
        ws.drop(f"e{k}")
    else:
        raise RuntimeError("the graph did not contract")
    if not tables:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("u").alias("node"), F.col("v").alias("root")).schema)
    out = tables[-1].select(F.col("u").alias("node"), F.col("f").alias("root"))
    for k in range(len(tables) - 2, -1, -1):
        up = out.select(F.col("node").alias("f"), F.col("root"))
        step = tables[k]
        to = step.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        out = salted_join(step, up, ["f"], "left", _heavy(to, "f") if nodes[k] >= LEAST else [], F.col("u")).select(F.col("u").alias("node"), F.coalesce("root", "f").alias("root"))
        out = ws.keep(out, f"root{k}")
    return out


@dataclass
class Components:
    """The persisted state, of tables that only grow and one small table of renamed components.

    A batch adds rows for its own keys, records and weights and never rewrites those of earlier ones: a component
    that was merged away keeps its old number there, and ``renames`` leads to the one it is part of now.
    """

    keys: DataFrame  # key binary, comp bigint
    sizes: DataFrame  # comp bigint, split string, weight bigint: added to, so several rows may belong together
    nodes: DataFrame  # node bigint, comp bigint, split string: what every record was given
    renames: DataFrame  # comp bigint, root bigint: one row per component merged away, always to a living one
    added: tuple[DataFrame, DataFrame, DataFrame] | None = None  # the last batch's rows of the first three

    _TABLES = ("keys", "sizes", "nodes")

    @staticmethod
    def empty(spark: SparkSession) -> "Components":
        return Components(*[spark.createDataFrame([], x) for x in ("key binary, comp bigint", "comp bigint, split string, weight bigint", "node bigint, comp bigint, split string", "comp bigint, root bigint")])

    def save(self, path: str, batch: int) -> None:
        """Append the last batch's rows; the renames are written beside those of earlier batches, which stay readable."""
        for name, rows in zip(self._TABLES, self.added or (self.keys, self.sizes, self.nodes)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        self.renames.write.mode("overwrite").parquet(f"{path}/renames/batch={batch}")

    @staticmethod
    def load(spark: SparkSession, path: str, batch: int) -> "Components":
        """The state after ``batch``; files of a later batch that failed half-way are not seen."""
        none = Components.empty(spark)
        kept = [spark.read.schema(f"{x}, batch int").parquet(f"{path}/{name}").where(F.col("batch") <= batch).drop("batch") for name, x in zip(none._TABLES, [", ".join(f"{c} {k}" for c, k in t.dtypes) for t in (none.keys, none.sizes, none.nodes)])]
        return Components(*kept, spark.read.parquet(f"{path}/renames/batch={batch}"))

    def current(self, rows: DataFrame, salt_with: str) -> DataFrame:
        """``rows`` with ``comp`` led to the living component."""
        up = self.renames.select("comp", "root")
        return salted_join(rows, up, ["comp"], "left", heavy_keys(rows, "comp"), F.col(salt_with)).withColumn("comp", F.coalesce("root", "comp")).drop("root")


def key_hash(*parts):
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def attach(state: Components, nodes: DataFrame, ties: DataFrame, ws: Workspace, fresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (node, comp), new keys (key, comp), merged (comp, root)) after a batch joined the state.

    ``nodes`` is (node), ``ties`` (node, key).  A component is named by its smallest node, so nodes of later
    batches should have larger numbers; if not, the older component is merged into the newer name.
    """
    ties = ws.keep(ties.where("key is not null and node is not null").distinct(), "ties")
    hubs = ws.keep(ties.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")), "hubs")
    heavy = _heavy(hubs.select("key", "n"), "key")
    h = hubs.select("key", "hub")
    edges = salted_join(ties, h, ["key"], "inner", heavy, F.col("node"), ways=48).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    known = None
    if not fresh:
        # of the state only the batch's own keys go on, and where they lead now
        known = ws.keep(state.current(state.keys.join(h, "key"), "key").select("key", "hub", "comp"), "known")
        edges = edges.unionByName(known.select(F.col("hub").alias("u"), F.col("comp").alias("v")))
    roots = contract(edges, ws)
    members = nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"))
    new = h if known is None else h.join(known.select("key"), "key", "left_anti")
    keys = new.join(roots.withColumnRenamed("node", "hub"), "hub", "left").select("key", F.coalesce("root", "hub").alias("comp"))
    if known is None:
        merged = state.renames
    else:
        merged = known.select("comp").distinct().join(roots.withColumnRenamed("node", "comp"), "comp").where("comp <> root").select("comp", "root")
    return ws.keep(members, "members"), keys, merged


def fill_deficits(new: DataFrame, placed: dict[str, int], targets: dict[str, float], seed: int = 20260725, large: float = 0.001, buckets: int = 4096) -> DataFrame:
    """(comp, split) for the components ``new`` (comp, weight), so that the shares come near ``targets``.

    Components above ``large`` of the total (fewer than 1/large) are placed one by one on the driver, largest
    first, where the deficit is greatest.  All others are spread over hash buckets; the bucket weights, a fixed number
    of rows, are cut to fill what is then missing.
    """
    spark = new.sparkSession
    total = (new.agg(F.sum("weight")).first()[0] or 0) + sum(placed.values())
    have = {s: placed.get(s, 0) for s in targets}
    norm = sum(targets.values()) or 1.0
    goal = {s: t / norm * total for s, t in targets.items()}
    big = new.where(F.col("weight") > max(1, large * total)).orderBy(F.desc("weight"), "comp").collect()
    chosen = []
    for r in big:
        s = max(goal, key=lambda k: (goal[k] - have[k], goal[k], k))
        have[s] += r["weight"]
        chosen.append((r["comp"], s))
    b = F.pmod(F.xxhash64(F.col("comp"), F.lit(seed)), F.lit(buckets))
    small = new.where(F.col("weight") <= max(1, large * total)).withColumn("b", b)
    weights = {r["b"]: r["w"] for r in small.groupBy("b").agg(F.sum("weight").alias("w")).collect()}
    need = {s: max(0.0, goal[s] - have[s]) for s in goal}
    # the cuts run through the buckets in order: each bucket goes where the running need still lies
    rest, where, order = sum(weights.values()), {}, sorted(goal, key=lambda s: (-need[s], s))
    scale = rest / (sum(need.values()) or 1.0)
    ends, acc = [], 0.0
    for s in order:
        acc += need[s] * scale
        ends.append((acc, s))
    run = 0.0
    for k in sorted(weights):
        mid = run + weights[k] / 2
        where[k] = next((s for e, s in ends if mid <= e), order[0] if order else None)
        run += weights[k]
    table = spark.createDataFrame(list(where.items()) or [(-1, "")], "b bigint, split string")  # at most ``buckets`` rows
    out = small.join(F.broadcast(table), "b").select("comp", "split")
    return out.unionByName(spark.createDataFrame(chosen, "comp bigint, split string")) if chosen else out


def advance(state: Components, nodes: DataFrame, ties: DataFrame, targets: dict[str, float], ws: Workspace, seed: int = 20260725) -> tuple[Components, DataFrame]:
    """One batch: (new state, (node, comp, split) of the batch's nodes).

    A component tied to exactly one split keeps it; tied to several it is quarantined, and stays so: its new records
    are held back, the older ones keep what they were given (``conflicts`` names them) and count there when the deficits
    are filled.  A new component fills a deficit.  Records that were given a split before are not given another:
    a batch should bring new ones.
    """
    fresh = state.keys.limit(1).count() == 0 and state.sizes.limit(1).count() == 0
    members, keys, merged = attach(state, nodes, ties, ws, fresh)
    keys, merged = ws.keep(keys, "keys"), ws.keep(merged, "merged")
    # the small table of renames: earlier ones whose target was merged now are led on
    onward = merged.select(F.col("comp").alias("root"), F.col("root").alias("next"))
    renames = state.renames.join(onward, "root", "left").select("comp", F.coalesce("next", "root").alias("root")).unionByName(merged)
    after = Components(state.keys, state.sizes, state.nodes, ws.keep(renames, "renames"))

    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    if fresh:
        held = sizes.withColumn("split", F.lit(None).cast("string"))
        placed: dict[str, int] = {}
    else:
        old = after.current(state.sizes.groupBy("comp", "split").agg(F.sum("weight").alias("weight")), "split").groupBy("comp", "split").agg(F.sum("weight").alias("weight"))
        old = ws.keep(old, "old")
        placed = {r["split"]: r["w"] for r in old.where(F.col("split") != QUARANTINE).groupBy("split").agg(F.sum("weight").alias("w")).collect()}
        status = old.groupBy("comp").agg(F.min("split").alias("a"), F.max("split").alias("b")).select("comp", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(QUARANTINE).alias("split"))
        held = sizes.join(status, "comp", "left").select("comp", "weight", "split")
    held = ws.keep(held, "held")
    for r in held.where("split is not null").groupBy("split").agg(F.sum("weight").alias("w")).collect():
        if r["split"] != QUARANTINE:
            placed[r["split"]] = placed.get(r["split"], 0) + r["w"]
    filled = fill_deficits(held.where("split is null").select("comp", "weight"), placed, targets, seed)
    grown = held.where("split is not null").select("comp", "split", "weight").unionByName(held.drop("split").join(filled, "comp").select("comp", "split", "weight"))
    grown = ws.keep(grown, "grown")
    heavy = _heavy(grown.select("comp", F.col("weight").alias("n")), "comp")
    given = salted_join(members, grown.select("comp", "split"), ["comp"], "inner", heavy, F.col("node")).select("node", "comp", "split")
    given = ws.keep(given, "given")
    new = Components(state.keys.unionByName(keys), state.sizes.unionByName(grown), state.nodes.unionByName(given), after.renames, (keys, grown, given))
    return new, given


def conflicts(state: Components) -> DataFrame:
    """(node, comp, split): records already placed whose component now holds several splits: the leak a merge uncovered."""
    sizes = state.current(state.sizes, "split").where(F.col("split") != QUARANTINE)
    torn = sizes.groupBy("comp").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("comp")
    placed = state.current(state.nodes.where(F.col("split") != QUARANTINE), "node")
    return salted_join(placed, torn, ["comp"], "left_semi", heavy_keys(placed, "comp"), F.col("node")).select("node", "comp", "split")
