"""Deeply nested records to related flat tables with parent-child links.

A bottom-up tree automaton gives every node a state: leaves by their type, a list by the states of its
elements, an item by the states of its fields.  The state of an item names its variant; items are routed to a typed
subtype table for each variant, all of which share the keys of the supertype (record, place in the list, own
id), and children carry the key of the parent row, so the tables join back without loss.  Shapes that no rule
knows have a table of their own with the whole item as JSON.

Input is a VARIANT value, so records that hold a typed struct and records that hold JSON text
take the same path; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .skew import union_all

#: The automaton's leaf rules: head of the type of a node -> state; any other head is a scalar.
STATES = {"OBJECT": "object", "ARRAY": "list", "STRING": "text", "VOID": "null", "NONE": "absent"}


def state_of(v: Column) -> Column:
    """State of one node: object, list, text, null, scalar, or absent (refers to ``v`` once)."""
    rules = F.create_map(*[F.lit(x) for rule in STATES.items() for x in rule])
    head = F.substring_index(F.coalesce(F.schema_of_variant(v), F.lit("NONE")), "<", 1)
    return F.coalesce(F.try_element_at(rules, head), F.lit("scalar"))


def is_some(v: Column) -> Column:
    """The node is there and is not null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def as_list(v: Column) -> Column:
    """A list slot as array<variant>: one object or text alone is a list of one, anything missing is empty."""
    alone = F.when(is_some(v), F.array(v)).otherwise(F.expr("cast(array() as array<variant>)"))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), alone)


def field(v: Column, *names: str) -> Column:
    """First of the named fields of an object node that is present and not null, as text."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def graph_variant(struct_col: str = "graph", text_col: str = "graph_json") -> Column:
    """The record's graph as one VARIANT, wherever it was stored.

    The struct wins over the text; text that is no JSON gives null.
    """
    v = F.coalesce(F.try_parse_json(F.to_json(F.col(struct_col))), F.try_parse_json(F.col(text_col)))
    return v


def unwrapped(v: Column) -> Column:
    """The object under a field ``graph`` if there is one, else the value itself."""
    inner = F.try_variant_get(v, "$.graph", "variant")
    return F.when(state_of(inner) == "object", inner).otherwise(v)


def graph_roots(df: DataFrame, record_key: str = "record_id", struct_col: str = "graph", text_col: str = "graph_json") -> DataFrame:
    """(record_key, entities, relations, answer_aspects as lists, shape, graph_sufficient, route_reason): one row per record.

    ``shape`` is the state of the root and of its three list slots, e.g. ``object(list,absent,object)``.
    """
    g = F.col("_g")
    base = df.select(F.col(record_key), graph_variant(struct_col, text_col).alias("_v")).select(record_key, unwrapped(F.col("_v")).alias("_g"))
    slots = {n: F.try_variant_get(g, f"$.{n}", "variant") for n in ("entities", "relations", "answer_aspects")}
    shape = F.concat(state_of(g), F.lit("("), F.concat_ws(",", *[state_of(s) for s in slots.values()]), F.lit(")"))
    return base.select(
        record_key,
        shape.alias("shape"),
        F.try_variant_get(g, "$.graph_sufficient", "boolean").alias("graph_sufficient"),
        F.try_variant_get(g, "$.route_reason", "string").alias("route_reason"),
        *[as_list(s).alias(n) for n, s in slots.items()],
    )


#: Slots of a record and the kind of their items.
SLOTS = {"entity": "entities", "relation": "relations", "aspect": "answer_aspects"}
#: Text fields an item of a kind may have; the first present of ``KEYS`` is its own id.
FIELDS = {"entity": ("entity_id", "id", "name", "label", "type"), "relation": ("edge_id", "source", "relation", "target", "question_relevance"), "aspect": ("aspect_id", "description", "question_relevance")}
KEYS = {"entity": ("entity_id", "id"), "relation": ("edge_id",), "aspect": ("aspect_id",)}
EVIDENCE = "evidence_snippet_ids"
#: The typed columns of each subtype table beside the keys of the supertype.  ``other`` holds
#: every shape no rule knows.
SUBTYPES = {
    ("entity", "standard"): ("entity_id", "name", "type"),
    ("entity", "alias"): ("id", "label", "type"),
    ("entity", "mixed"): ("entity_id", "id", "name", "label", "type"),
    ("entity", "nameless"): ("type",),
    **{(k, v): (*FIELDS[k], *e) for k in ("relation", "aspect") for v, e in {"cited": ("evidence",), "cited_nested": ("evidence",), "cited_one": ("evidence_one",), "uncited": ()}.items()},
    **{(k, "bare"): ("text",) for k in SLOTS},
    ("entity", "other"): ("item",),
    **{(k, "other"): ("item", "evidence") for k in ("relation", "aspect")},
}


def _leaf(state: Column) -> Column:
    return state.isin("text", "scalar", "null", "absent")


def variant_of(kind: str, v: Column) -> Column:
    """The automaton's step from the states of an item's children to the state of the item, which names its table.

    text: ``bare``.  An object with a list or object where a text belongs, a list and a scalar: ``other``.  Entities:
    ``standard`` by entity_id or name, ``alias`` by id or label, ``mixed`` by both, else ``nameless``.  Relations and
    aspects: by the state of their evidence, itself made from its elements: ``cited``, ``cited_nested`` (objects or
    lists among them), ``cited_one`` (no list), ``uncited``.
    """
    own = state_of(v)
    child = {f: state_of(F.try_variant_get(v, f"$.{f}", "variant")) for f in FIELDS[kind]}
    some = {f: c.isin("text", "scalar") for f, c in child.items()}
    plain = reduce(lambda a, b: a & b, [_leaf(c) for c in child.values()])
    if kind == "entity":
        mine, other = some["entity_id"] | some["name"], some["id"] | some["label"]
        shape = F.when(mine & other, "mixed").when(mine, "standard").when(other, "alias").otherwise("nameless")
    else:
        ev = F.try_variant_get(v, f"$.{EVIDENCE}", "variant")
        deep = F.exists(F.try_variant_get(ev, "$", "array<variant>"), lambda e: state_of(e).isin("object", "list"))
        s = state_of(ev)
        shape = F.when(s == "list", F.when(deep, "cited_nested").otherwise("cited")).when(s.isin("null", "absent"), "uncited").otherwise("cited_one")
    return F.when(own == "text", "bare").when((own == "object") & plain, shape).otherwise("other")


def routed(df: DataFrame, ws: Workspace, record_key: str = "record_id", struct_col: str = "graph", text_col: str = "graph_json") -> DataFrame:
    """Every non-null item of every record, in the table of its kind and variant.

    Each record is parsed once.  Rows are gathered by (kind, variant) into files of even size (a variant of a third of
    all rows fills many) and written to a folder for each, so a subtype table reads its own rows only.
    Columns: the supertype's (record, item_pos, item_key), the typed fields, kind and variant.
    """
    g, i = F.col("_g"), F.col("item")
    base = df.select(F.col(record_key), graph_variant(struct_col, text_col).alias("_v")).select(record_key, unwrapped(F.col("_v")).alias("_g"))
    slots = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get(g, f"$.{n}", "variant").alias("slot")) for k, n in SLOTS.items()])
    x = base.select(record_key, F.explode(slots).alias("s")).where("s.slot is not null")
    x = x.select(record_key, "s.kind", F.posexplode(as_list(F.col("s.slot"))).alias("_p", "item")).where(is_some(i))

    def by_kind(one) -> Column:
        kinds = list(SLOTS)
        out = F.when(F.col("kind") == kinds[0], one(kinds[0]))
        for k in kinds[1:]:
            out = out.when(F.col("kind") == k, one(k))
        return out

    x = x.withColumn("variant", by_kind(lambda k: variant_of(k, i)))
    ev = F.when(F.col("kind") != "entity", F.try_variant_get(i, f"$.{EVIDENCE}", "variant"))
    # an object in an evidence list is kept as its JSON text: a row is never dropped for its shape
    texts = F.transform(as_list(ev), lambda e: F.when(is_some(e), F.coalesce(F.try_variant_get(e, "$", "string"), F.to_json(e))))
    fields = {f: [k for k in SLOTS if f in FIELDS[k]] for k in SLOTS for f in FIELDS[k]}
    x = x.select(
        record_key,
        (F.col("_p") + 1).cast("int").alias("item_pos"),
        F.coalesce(by_kind(lambda k: field(i, *KEYS[k])), F.lit("")).alias("item_key"),
        *[F.when(F.col("kind").isin(ks), field(i, f)).alias(f) for f, ks in fields.items()],
        F.when(F.size(texts) > 0, texts).alias("evidence"),
        F.when(F.col("variant") == "bare", F.try_variant_get(i, "$", "string")).alias("text"),
        F.when(F.col("variant") == "other", F.to_json(i)).alias("item"),
        "kind",
        "variant",
    )
    return ws.route(x.hint("rebalance", "kind", "variant"), "items", ["kind", "variant"])


def variants(items: DataFrame) -> list[tuple[str, str]]:
    """The (kind, variant) pairs that occur: at most as many as SUBTYPES."""
    return sorted(map(tuple, items.select("kind", "variant").distinct().collect()))


def subtype(items: DataFrame, kind: str, variant: str, record_key: str = "record_id") -> DataFrame:
    """The typed table of one variant: the supertype's keys and its own columns."""
    t = items.where((F.col("kind") == kind) & (F.col("variant") == variant))
    cols = [F.get("evidence", F.lit(0)).alias(c) if c == "evidence_one" else F.col(c) for c in SUBTYPES[kind, variant]]
    return t.select(record_key, "item_pos", "item_key", *cols)


def _all(tables: list[DataFrame], spark, schema: str) -> DataFrame:
    return union_all(tables) if tables else spark.createDataFrame([], schema)


def of_kind(items: DataFrame, kind: str, columns: dict[str, tuple[str, ...]], record_key: str = "record_id") -> DataFrame:
    """Union of a kind's subtype tables under common names: each column is the first of its source fields that the
    subtype has and that is not null."""
    out = []
    for k, v in variants(items):
        if k == kind:
            t = subtype(items, k, v, record_key)
            cols = [F.coalesce(*[F.col(c) for c in src if c in t.columns], F.lit(None).cast("string")).alias(name) for name, src in columns.items()]
            out.append(t.select(record_key, "item_pos", "item_key", *cols, F.lit(v).alias("variant")))
    kinds = ", ".join(f"{c} string" for c in columns)
    return _all(out, items.sparkSession, f"{record_key} {dict(items.dtypes)[record_key]}, item_pos int, item_key string, {kinds}, variant string")


def evidence(items: DataFrame, kind: str, record_key: str = "record_id") -> DataFrame:
    """(record, parent, item_pos, sub_pos, snippet_id): the child table of a kind's citing subtypes.

    Places count from 1; null elements give no row but keep their place.
    """
    out = []
    for k, v in variants(items):
        if k != kind or not SUBTYPES[k, v] or not SUBTYPES[k, v][-1].startswith("evidence"):
            continue
        t = subtype(items, k, v, record_key)
        one = F.array("evidence_one") if "evidence_one" in t.columns else F.col("evidence")
        x = t.select(record_key, "item_pos", F.posexplode(one).alias("_p", "snippet_id")).where("snippet_id is not null")
        out.append(x.select(record_key, F.lit(kind).alias("parent"), "item_pos", (F.col("_p") + 1).cast("int").alias("sub_pos"), "snippet_id"))
    return _all(out, items.sparkSession, f"{record_key} {dict(items.dtypes)[record_key]}, parent string, item_pos int, sub_pos int, snippet_id string")


def supertype(items: DataFrame, record_key: str = "record_id") -> DataFrame:
    """(record, child, item_pos, sub_pos, item_key): the union of the keys of all subtype tables and their children.

    A record that stands on several rows gives its rows for each; the record key is unique in clean input.
    """
    own = [subtype(items, k, v, record_key).select(record_key, F.lit(k).alias("child"), "item_pos", F.lit(0).alias("sub_pos"), "item_key") for k, v in variants(items)]
    below = [evidence(items, k, record_key).select(record_key, F.concat("parent", F.lit("_evidence")).alias("child"), "item_pos", "sub_pos", F.col("snippet_id").alias("item_key")) for k in SLOTS if k != "entity"]
    return union_all([*own, *below])


def relation_links(roots: DataFrame, record_key: str = "record_id") -> DataFrame:
    """Relations with the places of the entities they tie: ids win over names, the first of equals wins, null if none.

    The record's entities travel with the row, so the link needs no join.
    """
    r = roots.select(record_key, F.posexplode("relations").alias("_p", "item"), "entities")
    r = r.where(is_some(F.col("item")))

    def place(ref: Column) -> Column:
        ids = F.transform("entities", lambda e: F.coalesce(field(e, "entity_id", "id"), F.lit("")))
        names = F.transform("entities", lambda e: F.coalesce(field(e, "name", "label"), F.lit("")))
        at = F.coalesce(F.nullif(F.array_position(ids, ref), F.lit(0)), F.nullif(F.array_position(names, ref), F.lit(0)))
        return F.when(F.coalesce(ref, F.lit("")) != "", at).cast("int")

    i = F.col("item")
    return r.select(
        record_key,
        (F.col("_p") + 1).cast("int").alias("item_pos"),
        F.coalesce(field(i, "edge_id"), F.lit("")).alias("edge_key"),
        place(field(i, "source")).alias("source_pos"),
        place(field(i, "target")).alias("target_pos"),
    )
