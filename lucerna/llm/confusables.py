"""P10: text that looks the same but differs in its characters, brought to one form (a skeleton).

Decompose, replace every character by its prototype, decompose again: two texts a reader cannot
tell apart have equal skeletons.  Case, accents, raised figures and line breaks stay.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import heavy_keys, salted_join
from ..workspace import Workspace

# Letters whose printed shape equals a Latin letter's, as "look-alike prototype", by script.
LOOK_ALIKES = """
Cyrillic А A В B Е E Ѕ S І I Ј J К K М M Н H О O Р P С C Т T Х X Ү Y Ӏ I Ѵ V Ԍ G Ԛ Q Ԝ W
Cyrillic а a с c е e һ h і i ј j о o р p ѕ s у y х x ѵ v ԁ d ԛ q ԝ w ӏ l ү y
Greek Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J ο o ν v ϲ c ϳ j
Roman Ⅰ I Ⅴ V Ⅹ X Ⅼ L Ⅽ C Ⅾ D Ⅿ M ⅰ i ⅴ v ⅹ x ⅼ l ⅽ c ⅾ d ⅿ m
Armenian Օ O Տ S Ս U օ o ս u հ h ո n յ j ց g զ q
Coptic Ⲃ B Ⲏ H Ⲓ I Ⲕ K Ⲙ M Ⲛ N Ⲟ O Ⲣ P Ⲥ C Ⲧ T Ⲩ Y Ⲭ X Ⲍ Z ⲟ o ⲣ p ⲥ c
Cherokee Ꭰ D Ꭱ R Ꭲ T Ꭺ A Ꭻ J Ꭼ E Ꮃ W Ꮇ M Ꮋ H Ꮐ G Ꮓ Z Ꮩ V Ꮪ S Ꮮ L Ꮯ C Ꮲ P Ꮶ K Ᏼ B
Lisu ꓐ B ꓑ P ꓓ D ꓔ T ꓖ G ꓗ K ꓙ J ꓚ C ꓜ Z ꓝ F ꓟ M ꓠ N ꓡ L ꓢ S ꓣ R ꓦ V ꓧ H ꓪ W ꓫ X ꓬ Y ꓮ A ꓰ E ꓲ I ꓳ O ꓴ U
Latin ɑ a ɡ g ᴄ c ᴏ o ꜱ s ᴠ v ᴡ w ᴢ z
Micro µ μ
"""
# Hyphens, ligatures and line ends that read the same.
HYPHENS = "‐‑⁃﹣－"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Kinds of compatibility decomposition that change only width or kind of blank.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
# Format characters that print something, and ranges that print nothing although they are no format characters.
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
UNSEEN = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
#: Lower-case Greek letters of the loaded table that a reader tells from Latin ones in running text.
APART = "αβγδεζηθικλμξπρστυφχψω"


def read_table(path: str) -> dict[int, str]:
    """A look-alike table in the public format, ``hex ; hex hex ... ; kind # remark`` per line, as far as P10 lets texts be equal.

    Kept are letters that stand for letters of the same case, and marks and signs that stand for one of their own
    kind; ASCII characters, figures for letters, one letter for several and the letters of APART stay as they are.
    """
    out: dict[int, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
            if len(parts) < 2 or not parts[0] or " " in parts[0] or " " in parts[1]:
                continue
            ch, to = chr(int(parts[0], 16)), chr(int(parts[1], 16))
            if ord(ch) > 127 and ch not in APART and unicodedata.category(ch) == unicodedata.category(to):
                out[ord(ch)] = to
    return out


@lru_cache(maxsize=4)
def prototypes(path: str | None = None) -> dict[int, str]:
    """Code point -> prototype, made by rule from the character database, the fixed tables and, if ``path`` names one,
    a whole public look-alike table."""
    t: dict[int, str] = read_table(path) if path else {}
    for cp in range(128, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Zs":
            t[cp] = " "
        elif cat == "Cf" and cp not in VISIBLE_FORMATS:
            t[cp] = ""  # marks without width
        elif (d := unicodedata.decomposition(ch)) and d.startswith(SAME_LOOK):
            t[cp] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    t.update({cp: "" for a, b in UNSEEN for cp in range(a, b + 1)})
    t.update({ord(h): "-" for h in HYPHENS})
    t.update({ord(k): v for k, v in LIGATURES.items()})
    for line in LOOK_ALIKES.strip().splitlines():
        pairs = line.split()[1:]
        t.update({ord(a): b for a, b in zip(pairs[::2], pairs[1::2])})
    t[9] = " "
    return t


def skeleton_of(text: str, table: str | None = None) -> str:
    """The skeleton of one text; decomposition runs before and after the look-up."""
    if text.isascii() and "\t" not in text and "\r" not in text:
        return text
    t = unicodedata.normalize("NFD", text).translate(prototypes(table))
    return unicodedata.normalize("NFD", t).replace("\r\n", "\n")


def skeleton(text: Column, table: str | None = None) -> Column:
    """Skeleton of a text column; plain ASCII text never leaves the JVM.  Null stays null, empty stays empty.

    ``table``: a public look-alike table (see ``read_table``) that every executor can read.
    """

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: skeleton_of(x, table), na_action="ignore")

    plain = text.rlike(r"\A[\x00-\x08\x0a-\x0c\x0e-\x7f]*\z")
    return F.when(plain, text).otherwise(of(F.when(~plain, text)))


def consistent_form(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical text, changed): every text in its one form (composed again for storage)."""
    @F.pandas_udf(T.StringType())
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    sk = skeleton(F.col(text))
    d = docs.select(key, F.col(text).alias("_t"), composed(sk).alias("canonical"))
    return d.select(key, "canonical", (F.col("canonical") != F.col("_t")).alias("changed"))


def _digests(docs: DataFrame, key: str, text: str, ws: Workspace) -> DataFrame:
    """(key, class_id, raw): digests of the skeleton and of the text itself; the skeleton is made once."""
    d = docs.where(F.col(text).isNotNull()).select(key, F.unhex(F.sha2(skeleton(F.col(text)), 256)).alias("class_id"), F.unhex(F.sha2(F.col(text), 256)).alias("raw"))
    return ws.keep(d, "digests")


def _mixed(d: DataFrame) -> DataFrame:
    """(class_id, raw): the different texts of every class that holds two or more; copies of a text are one row."""
    raws = d.groupBy("class_id", "raw").agg(F.count(F.lit(1)).alias("n"))
    many = raws.groupBy("class_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("class_id")
    return raws.join(many, "class_id", "left_semi").select("class_id", "raw")


def look_alike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id): one row per document of a class that holds at least two different texts.

    ``class_id`` is the smallest key of the class.  Only keys and digests are shuffled, and texts are
    brought to one row per copy map-side before classes are formed.
    """
    d = _digests(docs, key, text, Workspace(docs.sparkSession, "look-alikes"))
    heavy = heavy_keys(d, "class_id")
    mine = salted_join(d.select(key, "class_id"), _mixed(d).select("class_id").distinct(), ["class_id"], "left_semi", heavy, F.col(key))
    first = mine.groupBy("class_id").agg(F.min(key).alias("_first"))
    return salted_join(mine, first, ["class_id"], "inner", heavy, F.col(key)).select(key, F.col("_first").alias("class_id"))


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: pairs of rows whose texts differ in their characters but read the same.

    Rows with null text pair with nothing.  Different texts of a class are paired first; the rows that hold them are
    named in the last step, so that copies of one text, however many, are never compared with each other.  A text
    that very many rows hold is spread.
    """
    ws = Workspace(docs.sparkSession, "look-alikes")
    d = _digests(docs, key, text, ws)
    m = ws.keep(_mixed(d), "texts")
    pairs = m.select("class_id", F.col("raw").alias("ra")).join(m.select("class_id", F.col("raw").alias("rb")), "class_id").where("ra < rb").select("ra", "rb")
    heavy = heavy_keys(d, "raw")
    one = salted_join(d.select(F.col(key).alias("x"), F.col("raw").alias("ra")), pairs, ["ra"], "inner", heavy, F.col("x"))
    both = salted_join(d.select(F.col(key).alias("y"), F.col("raw").alias("rb")), one, ["rb"], "inner", heavy, F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
