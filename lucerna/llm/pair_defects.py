"""Broken prompt and response pairs, each with the kind of its defect.

The evidence for a shortened response is tried in the order of its strength:

* ``prefix``: all distinct responses are sorted and neighbours compared; a response that another one goes on after,
  inside a word or after a word that ends no phrase, is a shortened version of it;
* ``limit``: a length at which responses without a final stop gather is a limit, and such a response of that length
  was cut by it;
* ``ending``: where both are silent, the sentence or word that breaks off.

Empty, copying, refusing responses and those in another language are told by rules, one Arrow pass over each pair;
the sort, the length histogram and all joins are Catalyst expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..workspace import Workspace

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")

# What stands for nothing, compared without case, spaces and outer quotes or brackets.
PLACEHOLDERS = """null none nil nan n/a na n.a. n.a - -- --- – — _ . .. ... … ? ?? ??? tbd todo undefined unknown empty blank
noanswer noanswergiven noanswerprovided noresponse nooutput notavailable notapplicable notprovided keineangabe k.a. sansréponse sinrespuesta нетответа"""

# Labels that may dress a repeated question.
LABELS = """q a question answer response prompt query input output request user assistant text theanswer thequestion thequestionis
youasked youaskedme yourquestion yourquestionwas frage antwort pregunta respuesta réponse domanda risposta вопрос ответ"""

# Function words by language ("strong" ones mark a sentence, not a bare name or list).
FUNCTION_WORDS = {
    "en": "the of and in is was were are be been by with to for from that which this these than when while has have had not no under after before their its at on or an as both because unless since until though although but only does did can cannot would should may might what how who whose yet of there it",
    "fr": "le la les des du de et est une un dans par pour sur avec chez sous que qui ne pas plus au aux ce cette ces ont été était être son sa ses mais ou où après avant entre depuis lors sans l d n qu aucune quel quelle",
    "de": "der die das den dem des und ist ein eine einer eines einem einen in im mit von vom zu zum zur bei auf für nicht wird wurde werden wurden nach vor durch als auch sich an am aus hat haben war waren unter über zwischen während keine kein welche welcher wie dass oder aber sollte",
    "es": "el la los las del de y es una un en con por para que se no al lo su sus fue fueron ha han más pero como entre sobre sin tras después desde durante hasta cuál qué ninguna debe",
    "it": "il lo la i gli le del della dei delle dello di e è una un uno in nel nella nei con per che si non al alla ai da dal dalla su sul sono stato stata ha hanno più ma come tra fra dopo nessuna deve",
    "pt": "o a os as do da dos das de e é uma um em no na nos nas com por para que se não ao à foi foram são mais mas como entre sobre sem após nenhuma deve",
    "nl": "de het een en van in is op te met voor niet dat die zijn werd werden door bij aan als ook naar uit om over na onder tussen geen",
}
STRONG = {
    "en": "the of in is was were are been by with to for from that which when while has have had under after before their because unless since although cannot between neither not did whereas",
    "fr": "le les des du de est une dans par pour avec chez sous que qui ont été entre",
    "de": "der die das den dem des ist eine einer im mit von zu bei auf für wird wurde nach zwischen",
    "es": "el los las del de es una en con por para que se fue entre hubo ninguna",
    "it": "il del della dei di è una nel con per che",
    "ru": "в на с и но по при не у из для что как был была были от до после под",
}

# Acts of answering, as they follow a refusing verb in English.
ACT = r"""(?:answer(?:ing)?|help(?:ing)?(?! but)|respond(?:ing)?|reply(?:ing)?|comment(?:ing)?(?: on)?|discuss(?:ing)?|advis(?:e|ing)|assist(?:ing)?|comply|engage|speculate|say|go into|talk about|speak (?:about|to)|support that|fulfil+
|(?:give|giving|provide|providing|offer(?:ing)?|share|sharing|make|making) (?:an? |any |you |such |this |that |the |medical |specific |personal |legal |clinical |further |more )*(?:answers?|advice|information|opinions?|guidance|recommendations?|responses?|repl(?:y|ies)|details?|diagnosis|assessments?|that|this|it))""".replace("\n", "")

# How a refusal is put, by language (apostrophes made plain, lower case).  The one who answers, or what
# binds them, must be the subject, and an act of answering what is refused.
REFUSALS = [
    rf"\b(?:i|we)(?:'m|'re| am| are) (?:sorry,? but )?(?:not able|unable|not allowed|not permitted|not in a position|not qualified|not comfortable|not authori[sz]ed)(?: to)? {ACT}\b",
    r"\b(?:i|we) (?:must |have to |need to |should |shall |will )?(?:respectfully |politely )?(?:decline|refuse|abstain|refrain)\b(?: to| from|,|\.|;| this| that| your| the (?:question|request)|$)",
    rf"\b(?:i|we) (?:cannot|can ?not|can't|could not|couldn't|won't|will not|may not|must not) {ACT}\b",
    rf"\bi (?:do not|don't) {ACT}\b",
    r"\bi (?:would|'d) (?:rather|prefer)(?: to)? (?:not|leave)\b",
    r"\b(?:the|this|that|your) (?:request|question|query) (?:has been|was|is|must be) (?:declined|refused|denied|rejected|blocked)(?=\s*(?:[.;:!,]|$))(?!, but)",
    rf"\b(?:assistant|chatbot|bot|ai|language model) (?:does not|doesn't|cannot|can't|will not|won't|is not able to|may not) (?:cover|address|{ACT})\b",
    r"\b(?:guidelines|rules|polic(?:y|ies)|instructions|terms) (?:do|does)(?: not|n't) (?:let|allow|permit) (?:me|us)\b",
    r"\b(?:against|outside|beyond|contrary to) (?:my|our) (?:rules|guidelines|polic(?:y|ies)|instructions|scope|remit|competence|expertise|abilities|capabilities|role)\b",
    r"\b(?:outside|beyond)(?: of)? what (?:i|we) (?:may|can|could|am|are)\b",
    r"\bnot (?:be )?appropriate for (?:me|us) to\b",
    rf"\bbetter not to {ACT}\b",
    r"\bno (?:reply|answer|response|advice|comment) (?:can|could|will|may) be (?:offered|given|provided|made)\b",
    rf"\bsomething (?:that )?(?:i|we) (?:won't|will not|can't|cannot|do not|don't) {ACT}\b",
    r"\bi (?:do not|don't) have (?:access to|the|enough|any) .{0,40}(?:to|needed|required)",
    r"^\W*(?:i'm|i am|we're|we are) (?:very |so |really )?sorry\W*$",
    r"\bje (?:ne|n') ?(?:peux|puis|pourrais|suis|veux)\b.{0,30}\b(?:répondre|aider|donner|fournir|conseiller|discuter|commenter|autorisée?|mesure)\b|\bje refuse de\b",
    r"\bno (?:puedo|podemos|me es posible|estoy autorizad[oa] (?:a|para)) (?:responder|contestar|ayudar|dar|ofrecer|proporcionar|comentar|aconsejar|hablar)",
    r"\b(?:ich (?:kann|darf|möchte|werde)|(?:kann|darf|möchte|werde) ich|wir (?:können|dürfen)|(?:können|dürfen) wir)\b.{0,80}\b(?:nicht|keine|keinen)\b.{0,40}(?:antwort|auskunft|helfen|rat|äußern|sagen|geben)",
    r"\b(?:я|мы) не (?:могу|можем|буду|будем|вправе|имею права|имеем права) (?:\w+ )?(?:ответить|отвечать|помочь|помогать|давать|дать|советовать|комментировать|обсуждать|предоставить)|\bотказываюсь\b",
    r"\bnon (?:posso|possiamo|sono in grado di) (?:rispondere|aiutare|fornire|dare|commentare)|\bnão (?:posso|podemos) (?:responder|ajudar|fornecer|dar|comentar)|\bik kan .{0,30}niet (?:beantwoorden|helpen|geven)",
]
# Words of which one at least stands in every refusal; the patterns are tried only then.
REFUSAL_WORDS = "i we me us my our assistant chatbot bot ai model request question query better reply answer response advice comment je refuse puedo podemos posible autorizado autorizada ich wir я мы отказываюсь posso possiamo sono podemos ik"
# Sentences that may stand beside a refusal without answering anything.
FRAMES = [
    r"^(?:please |kindly )?(?:consult|ask|see|contact|speak (?:to|with)|talk to|refer to|seek)\b", r"\bhelp (?:you )?with\b", r"^(?:thank|thanks)\b", r"\bgood question\b", r"^you (?:ask|asked|want)\b",
    r"\bis an? (?:serious|important|complex|sensitive) (?:condition|topic|matter|question|issue)\b", r"^(?:i'm|i am|we are|we're) sorry\b", r"^(?:unfortunately|apologies|sorry)\W*$",
    r"^(?:veuillez|consultez|merci)\b", r"^(?:consulte|por favor|gracias|lo siento)\b", r"^(?:bitte|danke|es tut mir leid)\b", r"^(?:пожалуйста|обратитесь|спасибо|извините|простите)",
]
#: Words of other content up to which an answer with a refusing sentence is a refusal.
MOST_OTHER_WORDS = 10


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad\x00-\x1f]+")
_OUTER = "\"'`[](){}<>*“”«»„‚‘’"
_NOT_ALNUM = re.compile(r"[\W_]+")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]+")
_ENDED = re.compile(r"[.!?。][\"'”»)\]*`_]*\s*\Z")
#: A stop inside a bracket that never closes is no end, as in "(p = 0.".
_UNCLOSED = re.compile(r"\([^()]{0,40}\Z")
_DOTS = re.compile(r"(\.\.\.|…)\s*\Z")
_LOOSE = re.compile(r"(?:[\w\s](?:\.\.\.|…)|\w\s?[-–,;:])\s*\Z")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PLAIN = str.maketrans("’ʼ`´", "''''")
_REFUSES = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
_FRAME = re.compile("|".join(FRAMES))
_NOTHING, _LABELS, _REFUSAL_WORDS = _set(PLACEHOLDERS), _set(LABELS), _set(REFUSAL_WORDS)
_FUNCTION = {k: _set(w) for k, w in FUNCTION_WORDS.items()}
_ALL_FUNCTION = frozenset().union(*_FUNCTION.values())
_STRONG = frozenset().union(*map(_set, STRONG.values()))
_DANGLING = frozenset(w for w in _ALL_FUNCTION if len(w) > 1)


def released(c: Column) -> Column:
    """The disposition says release, however spelled; null does not."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}]", "").isin("release", "released"), F.lit(False))


def is_empty(a: str | None) -> bool:
    if a is None:
        return True
    if len(a) > 60 and not a.isspace():
        return False
    core = _BLANK.sub("", a.lower())
    bare = core.strip(_OUTER)
    return not bare or bare in _NOTHING or core in _NOTHING


def copies_question(q: str | None, a: str) -> bool:
    """Nothing is left of the answer but labels once the question is taken out (its letters and digits, case aside)."""
    nq = _NOT_ALNUM.sub("", (q or "").lower())
    na = _NOT_ALNUM.sub("", a.lower())
    if not nq or nq not in na:
        return False
    rest = na.replace(nq, "")
    return not rest or rest in _LABELS


def refuses(a: str) -> bool:
    """Does the answer decline to answer?  Some sentence must refuse, and what the others say must be courtesy,
    referral or at most MOST_OTHER_WORDS words: an answer that goes on to answer is none."""
    low = a.lower().translate(_PLAIN)
    if _REFUSAL_WORDS.isdisjoint(_WORD.findall(low)) or not _REFUSES.search(low):
        return False
    other = 0
    for s in _SENTENCE.split(low.strip()):
        if not (_REFUSES.search(s) or _FRAME.search(s)):
            other += len(s.split())
    return other <= MOST_OTHER_WORDS


def language(text: str, words: set[str]) -> tuple[str | None, int]:
    """(language, score): the one whose function words occur most, Russian by script; None without evidence."""
    if not text.isascii():
        cyrillic = sum(map(len, _CYRILLIC.findall(text)))
        if cyrillic >= 6 and cyrillic * 3 >= sum(map(len, _WORD.findall(text))) - cyrillic:
            return "ru", 99
    known = words & _ALL_FUNCTION
    if not known:
        return None, 0
    score, _, lang = max((len(known & w), -i, k) for i, (k, w) in enumerate(_FUNCTION.items()))
    return lang, score


def other_language(q: str, a: str, wq: set[str], wa: set[str]) -> bool:
    lq, la = language(q, wq), language(a, wa)
    if lq[0] is None or la[0] is None or lq[0] == la[0]:
        return False
    if "ru" in (lq[0], la[0]):
        return True
    return la[1] >= 2 and la[1] > len(wa & _FUNCTION[lq[0]])


def is_sentence(tokens: list[str]) -> bool:
    """Four words with one that marks a sentence, or three Cyrillic words among them, or three ending in a function word of two letters or more."""
    n = len(tokens)
    if n < 3:
        return False
    dangling = tokens[-1] in _DANGLING
    if n == 3:
        return dangling
    return dangling or not _STRONG.isdisjoint(tokens) or sum(bool(_CYRILLIC.fullmatch(t)) for t in tokens) >= 3


def judge(q: str | None, a: str | None) -> tuple[str | None, bool, bool, bool]:
    """(defect told by rules, open, phrase, broken) of one pair: ``open`` has no final stop, ``phrase`` is open, has three
    words or more and is no list, ``broken`` breaks off as the ending alone shows."""
    if is_empty(a):
        return "empty", False, False, False
    if copies_question(q, a):
        return "copies_question", False, False, False
    if refuses(a):
        return "refusal", False, False, False
    tokens = _WORD.findall(a.lower())
    if q and other_language(q, a, set(_WORD.findall(q.lower())), set(tokens)):
        return "other_language", False, False, False
    inside = bool(_UNCLOSED.search(a))
    if _ENDED.search(a) and not _DOTS.search(a) and not inside:
        return None, False, False, False
    phrase = len(tokens) >= 3 and not any(c in a for c in ",;\n")
    return None, True, phrase, inside or bool(_LOOSE.search(a)) or is_sentence(tokens)


_VERDICT = T.StructType([T.StructField("defect", T.StringType()), *[T.StructField(n, T.BooleanType()) for n in ("open", "phrase", "broken")]])


@F.pandas_udf(_VERDICT)
def _judged(q: pd.Series, a: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(x, y) for x, y in zip(q, a)], columns=["defect", "open", "phrase", "broken"])


def prefix_neighbours(texts: DataFrame, ws: Workspace, col: str = "t") -> DataFrame:
    """(t, longer): distinct texts that are a strict prefix of their neighbour in sorted order, with that neighbour.

    If any text continues ``t`` then its immediate neighbour does.  The sort is range partitioned, so it stays
    balanced whatever the texts begin with; each range also sees the first text of the next one.
    """
    r = texts.where(F.col(col).isNotNull()).select(F.col(col).alias("t")).distinct()
    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = ws.keep(r.repartitionByRange(n, "t").withColumn("p", F.spark_partition_id()), "sorted")
    firsts = r.groupBy("p").agg(F.min("t").alias("t"))  # one row for each range
    guard = firsts.withColumn("p", F.lag("p").over(Window.orderBy("p"))).where("p is not null").select("t", "p")
    both = r.withColumn("own", F.lit(True)).unionByName(guard.withColumn("own", F.lit(False)))
    both = both.withColumn("longer", F.lead("t").over(Window.partitionBy("p").orderBy("t")))
    return both.where("own and longer is not null and startswith(longer, t)").select("t", "longer")


def length_spikes(unfinished: DataFrame, reach: int = 15, times: float = 8.0, sigmas: float = 5.0) -> DataFrame:
    """(n): lengths at which unfinished texts (column ``n``) gather: ``times`` the mean of the lengths within ``reach`` and
    ``sigmas`` standard deviations of a Poisson count above it, so that the test means the same at every corpus size."""
    h = unfinished.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    near = h.select(F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("n"), "c").groupBy("n").agg(F.sum("c").alias("around"))
    mean = (F.col("around") - F.col("c")) / (2 * reach)
    return h.join(near, "n").where((F.col("c") >= times * mean) & (F.col("c") >= mean + sigmas * F.sqrt(mean + 1))).select("n")


def defects(pairs: DataFrame, key: str = "pair_id", question: str = "question", answer: str = "bge_answer", disposition: str | None = "bge_final_disposition", others: tuple[str, ...] = ("hybrid_answer",)) -> DataFrame:
    """(key, defect, evidence): one row for each released pair whose answer is defective.

    ``others`` are further response columns that take part in the sort.  A null or blank answer is ``empty``; a
    null question has no copies and no language.  Kinds are tried in the order of DEFECTS, so no pair has two.
    ``evidence`` is what showed it: ``rule``, or for truncated answers ``prefix``, ``limit`` or ``ending``.  A key that
    stands on several rows gives a row for each.
    """
    ws = Workspace(pairs.sparkSession, "pair-defects")
    texts = pairs.select(F.col(answer).alias("t"))
    for o in others:
        texts = texts.unionAll(pairs.select(F.col(o).alias("t")))
    short = prefix_neighbours(texts, ws)
    # the cut is inside a word, or after a word that cannot end a phrase
    last = F.regexp_extract(F.lower("t"), r"(\p{L}+)\s*\z", 1)
    inside = F.substr("longer", F.length("t") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.col("t").rlike(r"[\p{L}\p{N}]\z")
    cut = (F.length("t") >= 8) & ((inside & F.col("t").rlike(r"\s")) | last.isin(sorted(_STRONG)))
    short = short.where(cut).select(F.unhex(F.md5("t")).alias("_m"), F.lit(True).alias("_short"))

    p = pairs.where(released(F.col(disposition))) if disposition else pairs
    d = p.select(key, F.unhex(F.md5(answer)).alias("_m"), F.length(answer).alias("n"), _judged(F.col(question), F.col(answer)).alias("v")).select(key, "_m", "n", "v.*")
    d = ws.keep(d, "judged")  # judged once; what follows reads digests, lengths and verdicts
    ruled = d.where("defect is not null").select(key, "defect", F.lit("rule").alias("evidence"))
    rest = d.where("open and defect is null")
    spikes = length_spikes(rest.select("n")).withColumn("_spike", F.lit(True))
    rest = rest.join(short, "_m", "left").join(spikes, "n", "left")
    why = F.when(F.col("_short"), "prefix").when(F.col("_spike") & F.col("phrase"), "limit").when(F.col("broken"), "ending")
    return ruled.unionByName(rest.select(key, F.lit("truncated").alias("defect"), why.alias("evidence")).where("evidence is not null"))
