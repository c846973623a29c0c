"""P5: text cut off by field limits.

Hidden limits come first.  Each text's length is taken under several measures (code points, UTF-8 and UTF-16
units, with entities, JSON or line ends escaped), grouped by (source, measure), and a limit shows as one
length at which far more texts of the source gather than at the lengths around, most of them broken off.

Then the endings are inspected.  At a limit of its source a text has lost its end unless it is whole: structure
closed, final stop, all its sections done, as in a reply padded to the limit.  Away from any limit, where a text
can only have been lost on the way, more is asked for: a structure that does not close, or a phrase that breaks
off.  Phrases without full stop are told from broken ones by the corpus itself: one that mostly stands before
other content is complete.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

#: How a stored text may have been measured by the field that cut it.
MEASURES = ("points", "utf8", "utf16", "entities", "entities_utf8", "json", "json_utf8", "json_ascii", "crlf", "crlf_utf8")


_CONTROL = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")


def sizes_of(t: str) -> list[int]:
    """Lengths of a text under MEASURES, by counting: no escaped copy is made."""
    n, utf8 = len(t), len(t.encode("utf-8", "surrogatepass"))
    astral = 0 if utf8 == n else len(t.encode("utf-16-le", "surrogatepass")) // 2 - n
    foreign = 0 if utf8 == n else n - len(t.encode("ascii", "ignore"))
    quotes, feeds = t.count('"'), t.count("\n")
    html = (t.count("<") + t.count(">")) * 3 + t.count("&") * 4 + (quotes + t.count("'")) * 5
    escapes = quotes + feeds + sum(map(t.count, "\\\r\t\x08\f")) + len(_CONTROL.findall(t)) * 5
    breaks = feeds - t.count("\r\n")
    return [n, utf8, n + astral, n + html, utf8 + html, n + escapes, utf8 + escapes, n + escapes + foreign * 5 + astral * 6, n + breaks, utf8 + breaks]


_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"\A\s*```[\w-]*[ \t]*\n?")
_ENDED = re.compile(r"[.!?。…][\"'”»)\]*_`]*\s*\Z")
#: A stop inside a bracket that never closes is no end, as in "(p = 0.".
_UNCLOSED = re.compile(r"\([^()]{0,40}\Z")
_SECTION = re.compile(r"(?:\A|\n|(?<=[.!?])[ \t])[ \t]*((?:[\w-]+ )?[A-Za-z]+\d+):\s")
_STOP = re.compile(r"[.!?](?=\s|\Z)")
#: What closes the brackets, strings and fence of a reply.
_CLOSERS = " \t\n\r\x0b\x0c\"}]`"
#: A cut that keeps characters whole, or a blank stripped after it, leaves a text this much below its limit at most.
SLACK = 3
_WORD_ITEM = re.compile(r"\A\s*(?:[-*•]|\d+[.)])\s")


def _closed(t: str) -> bool:
    """Do all brackets and strings of a text that opens with a bracket close?  (For JSON that a parser rejects.)"""
    depth, inside, skip = 0, False, False
    for ch in t:
        if skip:
            skip = False
        elif inside:
            if ch == "\\":
                skip = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return True
    return False


def _leaves(v, path: str, out: list) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            _leaves(x, k, out)
    elif isinstance(v, list):
        for x in v:
            _leaves(x, path, out)
    elif isinstance(v, str):
        out.append((path, v))


def _objects(v, out: list) -> None:
    """Innermost objects in document order."""
    if isinstance(v, dict):
        inner = [x for x in v.values() if isinstance(x, (dict, list)) and x and any(isinstance(y, dict) for y in (x if isinstance(x, list) else [x]))]
        if inner:
            for x in v.values():
                _objects(x, out)
        else:
            out.append(v)
    elif isinstance(v, list):
        for x in v:
            _objects(x, out)


def ending_of(text: str) -> tuple[str, str, str, list[str]]:
    """(form, verdict, last, phrases) of one reply.

    ``form``: json, prose, list or empty.  ``verdict``: open (structure broken off), ended, or unsure, in which
    case ``last`` is the final phrase (``field=text``) that decides.  ``phrases``: the texts without final
    stop that are followed by more, hence complete.
    """
    fence = _FENCE.match(text)
    t = text[fence.end():] if fence else text.lstrip()
    if t[:1] in ("{", "["):
        try:
            v, at = _DECODER.raw_decode(t)
        except ValueError:
            return "json", ("unsure" if _closed(t) else "open"), "", []
        tail = t[at:].strip()
        if fence and not tail.startswith("```"):
            return "json", "open", "", []
        objects: list = []
        _objects(v, objects)
        objects = [o for o in objects if isinstance(o, dict) and o]
        leaves: list = []
        for o in objects:
            _leaves(o, "", leaves)
        done = [f"{k}={x}" for k, x in leaves[:-1] if not _ENDED.search(x)]
        if len(objects) > 1:
            usual = set(objects[0])
            if not set(objects[-1]) >= usual and all(set(o) >= usual for o in objects[:-1]):
                return "json", "open", "", done  # the last item lacks fields that every other has
        if not leaves or _ENDED.search(leaves[-1][1]):
            return "json", "ended", "", done
        return "json", "unsure", f"{leaves[-1][0]}={leaves[-1][1]}", done
    if fence and "```" not in t:
        return "prose", "open", "", []
    body = t.replace("```", "").rstrip()
    if not body:
        return "empty", "ended", "", []
    lines = [x for x in body.split("\n") if x.strip()]
    if len(lines) > 1 and all(_WORD_ITEM.match(x) for x in lines) or (len(lines) == 1 and _WORD_ITEM.match(lines[0])):
        words = [re.split(r":\s*", x, maxsplit=1)[-1].strip() for x in lines]
        return "list", ("ended" if _ENDED.search(words[-1]) else "unsure"), f"item={words[-1]}", [f"item={w}" for w in words[:-1]]
    if _ENDED.search(body) and not _UNCLOSED.search(body):
        return "prose", "ended", "", []
    return "prose", "open", "", []


def stops_inside(text: str, form: str, expected: list[str] | None = None) -> bool:
    """Does a reply that ends with a full stop end inside its sections?

    Prose is read as sections ``label:``.  It is not done if the last section has fewer sentences than any other, or
    if the last of several rounds through the labels is shorter than the first.  ``expected``: the labels a whole
    reply names, in order; it is not done either if the final one is not named.  A text that goes on after its last
    section (more sentences than in any other) is done; so is one with fewer than two sections.
    """
    if form == "json":
        return bool(expected) and f'"{expected[-1]}"' not in text
    if form != "prose":
        return False
    body = text.replace("```", "").rstrip()
    heads = list(_SECTION.finditer(body))
    if len(heads) < 2:
        return False
    ends = [h.start() for h in heads[1:]] + [len(body)]
    n = [len(_STOP.findall(body[h.end() : e])) for h, e in zip(heads, ends)]
    if n[-1] > max(n[:-1]):
        return False
    labels = [h.group(1) for h in heads]
    starts = [i for i, x in enumerate(labels) if x == labels[0]]
    last = labels[starts[-1] :]
    short = len(starts) > 1 and len(last) < starts[1] and last == labels[: len(last)]
    return n[-1] < min(n[:-1]) or short or bool(expected) and expected[-1] not in {x.split()[-1] for x in labels}


_ENDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("form", "verdict", "last")]
    + [T.StructField("phrases", T.ArrayType(T.StringType())), T.StructField("inside", T.BooleanType()), T.StructField("reach", T.ArrayType(T.LongType()))]
)


def inspected(t: str, expected: list[str] | None) -> tuple[str, str, str | None, list[str], bool, list[int]]:
    """What is read from one reply: ``ending_of``, ``stops_inside`` and how far a cut may have gone under each measure: of
    closed JSON without its closers, which a repair may have added."""
    form, verdict, last, phrases = ending_of(t)
    repaired = form == "json" and verdict != "open"
    return form, verdict, last or None, sorted(set(phrases)), verdict == "ended" and stops_inside(t, form, expected), sizes_of(t.rstrip(_CLOSERS) if repaired else t)


@F.pandas_udf(_ENDING)
def _endings(texts: pd.Series, expected: pd.Series) -> pd.DataFrame:
    rows = [inspected(t, None if x is None else list(x)) for t, x in zip(texts, expected)]
    return pd.DataFrame(rows, columns=[f.name for f in _ENDING.fields])


def limits(found: DataFrame, source: str, reach: int = 20, times: float = 6.0, sigmas: float = 5.0, share: float = 0.5) -> DataFrame:
    """(source, measure, size, n_texts, n_unfinished): hidden limits.

    ``found`` has the source, an array ``reach`` over MEASURES and the flag ``unfinished``.  A size is a limit of its source if
    as many texts have it as ``times`` the mean of the sizes within ``reach`` and ``sigmas`` standard deviations of a
    Poisson count above it (a test that means the same at every corpus size), and at least the share ``share``
    of them is unfinished (terse complete replies gather too).  A limit shows under several measures; see ``own_limits`` for the one that explains a text.
    """
    each = found.select(source, "unfinished", F.posexplode("reach").alias("m", "size"))
    n = each.groupBy(source, "m", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("unfinished").alias("n_unfinished"))
    near = n.select(source, "m", F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach)).alias("size"), "n").groupBy(source, "m", "size").agg(F.sum("n").alias("around"))
    mean = (F.col("around") - F.col("n")) / (2 * reach)
    s = n.join(near, [source, "m", "size"]).where((F.col("n") >= times * mean) & (F.col("n") >= mean + sigmas * F.sqrt(mean + 1)) & (F.col("n_unfinished") >= share * F.col("n")))
    names = F.array(*[F.lit(x) for x in MEASURES])
    return s.select(source, F.element_at(names, F.col("m") + 1).alias("measure"), "size", F.col("n").alias("n_texts"), "n_unfinished")


def own_limits(found: DataFrame, source: str, share: float = 0.5) -> DataFrame:
    """(source, lims): the limits of each source, the one of most texts first, each as struct(n, place of its measure, size).

    A limit shows under several measures.  Every unfinished text is given to the limit of most texts that it fits;
    a limit left with less than ``share`` of its own is only another's shadow and drops out.  A source has few limits:
    two of one measure are a gathering apart.  Null sources have none.
    """
    names = F.array(*[F.lit(x) for x in MEASURES])
    lim = limits(found, source).where(F.col(source).isNotNull()).withColumn("p", (-F.array_position(names, F.col("measure"))).cast("int"))

    def listed(x: DataFrame) -> DataFrame:
        return x.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(F.col("n_unfinished").alias("n"), "p", "size")), asc=False).alias("lims"))

    given = found.where("unfinished").join(listed(lim), source).select(source, fitting(F.col("lims")).alias("x")).where("x is not null").groupBy(source, "x.p", "x.size").agg(F.count(F.lit(1)).alias("own"))
    return listed(lim.join(given, [source, "p", "size"]).where(F.col("own") >= share * F.col("n_unfinished")))


def fitting(lims: Column) -> Column:
    """The first limit that a text of the sizes ``reach`` comes up to, null if none."""
    return F.get(F.filter(lims, lambda x: F.get("reach", -x["p"] - 1).between(x["size"] - SLACK, x["size"])), F.lit(0))


def examine(records: DataFrame, key: str, text: str, source: str, share: float = 0.2, expected: str | None = None) -> DataFrame:
    """(key, source, form, reach, whole, unfinished): one row per record with a text.

    Null texts give no row.  ``whole``: structure closed, final stop, sections done.  ``unfinished``: lost its end even
    where no limit is near: an open structure, or a final phrase (same field, same text) of which less than two, or less
    than ``share`` of all, occurrences in the corpus stand before other content.  A share, so that more data does not
    clear more phrases.  ``reach``: see ``inspected``.  ``expected``: a column of the labels a whole reply names, see ``stops_inside``.
    """
    ws = Workspace(records.sparkSession, "truncation")
    t = F.col(text)
    x = F.col(expected) if expected else F.lit(None).cast("array<string>")
    d = records.where(t.isNotNull()).select(key, source, _endings(t, x).alias("e")).select(key, source, "e.*")
    d = ws.keep(d, "endings")
    loose = d.where("verdict = 'unsure'").select(key, F.col("last").alias("phrase")).where("phrase is not null")
    going_on = d.select(F.explode("phrases").alias("phrase"), F.lit(1).alias("before"))
    counted = going_on.unionByName(loose.select("phrase", F.lit(0).alias("before"))).groupBy("phrase").agg(F.sum("before").alias("before"), F.avg("before").alias("share"))
    known = counted.where((F.col("share") >= share) & (F.col("before") > 1)).select("phrase")
    broken = loose.join(known, "phrase", "left_anti").select(key).distinct().withColumn("_broken", F.lit(True))
    d = d.drop("last", "phrases").join(broken, key, "left")
    unfinished = (F.col("verdict") == "open") | F.coalesce("_broken", F.lit(False))
    whole = (F.col("verdict") == "ended") & ~F.col("inside")
    return ws.keep(d.select(key, source, "form", "reach", whole.alias("whole"), unfinished.alias("unfinished")), "examined")


def truncated(records: DataFrame, key: str, text: str, source: str, expected: str | None = None, with_limits: bool = True) -> DataFrame:
    """(key, source, form, truncated, limit_measure, limit_size): records with a text, and whether it lost its end.

    At a limit of its source (no longer, and at most SLACK shorter) a text that is not whole lost its end; elsewhere
    only an unfinished one.  Of several limits that fit, the one with most texts names the measure.
    ``with_limits``: False leaves the limits out, to see what they decide.
    """
    d = examine(records, key, text, source, expected=expected)
    if not with_limits:
        return d.select(key, source, "form", F.col("unfinished").alias("truncated"), F.lit(None).cast("string").alias("limit_measure"), F.lit(None).cast("long").alias("limit_size"))
    d = d.join(own_limits(d, source), source, "left").withColumn("lim", F.when(~F.col("whole"), fitting(F.col("lims"))))
    lost = F.col("unfinished") | F.col("lim").isNotNull()
    names = F.array(*[F.lit(x) for x in MEASURES])
    return d.select(key, source, "form", lost.alias("truncated"), F.get(names, -F.col("lim.p") - 1).alias("limit_measure"), F.col("lim.size").alias("limit_size"))
