"""Personal information inside free text: emails, phones, identity numbers, street addresses and names.

Method: weak-supervision aggregation. Patterns propose spans; labelers vote for, against or not at all on each: its format,
the lexicon word nearest before it in its sentence, its left context, its right context, the gazetteer, its shape.
Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is and how likely each pattern is
a true span; the soft labels train a logistic span classifier, whose decision per pattern is final. Vote patterns are few (at
most 3 to the power of the labelers), so only counts reach the driver.

Two labelers are learned from the table itself. The gazetteer of given names is mined from names after an introduction ("my
name is"): words that go with several different partners. Contexts (the two words before a span, the two behind it) are
promoted if a fair share of the different values that stand in them is sure by format, lexicon or gazetteer, and demoted if
hardly any is; names that stand in promoted contexts extend the gazetteer. A second pass looks for names in lower case, which
no pattern can propose, where the learned contexts and the gazetteer meet. So the fixed lists are small and general: words
for the kinds themselves, for numbers that are nobody's, and one introduction a language.

Null and empty texts hold no spans. A value found twice in a transcript is reported once; all its places are redacted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.markup import headless
from turnwise.session import map_batches, stash

KINDS = ("email", "phone", "id_number", "address", "name")
LABELERS = ("format", "lexicon", "left", "right", "gazetteer", "shape")
LEFT, RIGHT, GAZETTEER = LABELERS.index("left"), LABELERS.index("right"), LABELERS.index("gazetteer")
MAX_BROADCAST = 20_000
MAX_CONTEXTS = 1_000_000
MIN_PARTNERS = 3
MIN_VALUES = 3  # different values before a context counts for
SURE_SHARE = 0.15
MIN_DOUBTED = 5  # different values before a context counts against
DOUBTED_SHARE = 0.02
ROUNDS = 25

# fixed values: words for each kind of thing, and for numbers and names that are nobody's, in six languages (beginnings of words)
LEXICON = {
    "email": ("почт", "имейл", "мейл", "email", "e-mail", "mail", "пошт"),
    "phone": ("телефон", "звон", "номер телефона", "phone", "call me", "telefon", "ruf mich", "zadzwoń", "дзвон", "тэлефон", "mobile", "мобильн", "handy"),
    "id_number": ("паспорт", "снилс", "инн ", "номер документа", "удостоверен", "passport", "national id", "social security", "податковий номер", "посвідчен", "steuernummer", "versicherungsnummer", "personalausweis", "pesel", "dowód", "dowodu", "paszport", "пашпарт", "асабісты нумар", "пасведчан"),
    "address": ("адрес", "живу", "address", "i live", "wohne", "adresse", "mieszkam", "adres", "адрас", "жыву"),
    "other": ("заказ", "заявк", "код отправки", "кабинет", "этаж", "верси", "order number", "ticket", "tracking", "room", "floor", "version", "замовлен", "код відправлення", "кабінет", "поверс", "версі", "bestellung", "vorgang", "sendung", "raum", "stockwerk", "zamówien", "zgłoszen", "kod przesyłki", "sala", "piętr", "wersj", "заяўк", "код адпраўкі", "вэрсі", "паверх"),
    "place": ("кафе", "кав'ярн", "кав’ярн", "кавярн", "cafe", "café", "улиц", "вулиц", "вуліц", "street", "straße", "ulic", "ресторан", "restaurant", "hotel", "станци", "вокзал", "station"),
}
INTRODUCTIONS = ("меня зовут", "my name is", "мене звати", "mein name ist", "nazywam się", "мяне завуць")

G = r"[ \t   ​]{1,4}"
_AT = r"(?:at|ät|собака|собачка|равлик|сабака|małpa)"
_DOT = r"(?:dot|punkt|точка|крапка|кропка|kropka)"
_HOST = r"[A-Za-z0-9][A-Za-z0-9-]*"
_SPELLED_WORDS = (" at ", "(at)", "[at]", " ät ", "(ät)", "собака", "собачка", "равлик", "сабака", "małpa", " dot ", " punkt ", "точка", "крапка", "кропка", "kropka")
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+-]*(?:{G})?@(?:{G})?{_HOST}(?:\.{_HOST})+")
SPELLED = re.compile(
    rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:{G}{_DOT}{G}[A-Za-z0-9._+-]+)*{G}(?:@|[\(\[\{{]{_AT}[\)\]\}}]|{_AT}){G}{_HOST}(?:(?:\.|{G}[\(\[]?(?:{_DOT})[\)\]]?{G}|{G}?[\(\[]\.[\)\]]{G}?){_HOST})+", re.I
)
PHONE = re.compile(r"(?<![\w+.,/№-])(?:\+\d{1,3}|\(\d{2,5}\)|00\d{2}|\d)(?:[    .\-–/()]{0,3}\d){6,15}(?![\w]|[-./]\d)")
_U = r"[A-Za-zА-Яа-яЁёІіЇїЄєҐґЎў]"
IDS = re.compile(
    rf"(?<![\w+№'’-])(?:{_U}{{1,3}}(?:[  ]№)?[  ]?\d{{5,9}}|\d{{2}}{G}\d{{2}}{G}№{G}\d{{6}}|\d{{4}}{G}(?:№{G})?\d{{6}}|\d{{2}}{G}\d{{2}}{G}\d{{6}}|\d{{3}}-\d{{3}}-\d{{3}}[ -]\d{{2}}|\d{{3}}-\d{{2}}-\d{{4}}"
    rf"|{_U}{{2}}(?:{G})?\d{{2}}(?:{G})?\d{{2}}(?:{G})?\d{{2}}(?:{G})?{_U}|\d{{2}}{G}\d{{6}}{G}{_U}{G}\d{{3}}|\d{{2}}{G}\d{{3}}{G}\d{{3}}{G}\d{{3}}|\d{{7}}{_U}\d{{3}}{_U}{{2}}\d|\d{{9,12}})(?![\w]|-\d)"
)
_NAMED = r"[^\W\d_][^\W\d_'’-]+(?:-[^\W\d_]+)?"
_HOUSE = r"\d{1,4}[A-Za-zА-Яа-яІіЎў]?"
ADDRESS = (
    (("ул", "пер", "вул", "пров", "зав", "просп"), re.compile(
        rf"(?<!\w)(?:(?:улица|переулок|проспект|бульвар|вулиця|провулок|вуліца|завулак){G}|(?:ул|пер|просп|вул|пров|зав)\.?{G}){_NAMED}(?:{G}{_NAMED})?,?{G}(?:(?:дом|д\.|буд\.|будинок){G}?)?{_HOUSE}(?:[-/]\d{{1,4}})?(?!\w)(?:,{G}(?:кв\.|квартира){G}\d{{1,4}})?"
        rf"|(?<!\w)(?!адрес){_NAMED}(?:{G}{_NAMED})?{G}(?:улица|переулок|проспект|вулиця|вуліца),{G}(?:дом{G})?{_HOUSE}(?:[-/]\d{{1,4}})?(?!\w)", re.I)),
    (("ul", "al.", "alej", "plac"), re.compile(rf"(?<!\w)(?:ulica|ul\.|al\.|aleja|plac|pl\.){G}{_NAMED}(?:{G}{_NAMED})?{G}{_HOUSE}(?:/\d{{1,4}})?(?!\w)(?:{G}m\.{G}\d{{1,4}})?", re.I)),
    (("str", "weg", "am ", "gasse", "platz", "allee", "im ", "an der"), re.compile(rf"(?<!\w)(?:[^\W\d_-]+(?:straße|strasse|str\.|weg|gasse|platz|allee)|(?:Am|Im|An{G}der|Zum){G}{_NAMED}){G}{_HOUSE}(?!\w)", re.I)),
    (("street", "rd", "road", "lane", "ave", " st"), re.compile(rf"(?<!\w)(?:(?:Flat|Apt|Unit){G}\d{{1,4}},{G})?{_HOUSE}{G}{_NAMED}(?:{G}{_NAMED})?{G}(?:Street|Road|Rd|Lane|Avenue|Ave|St)(?!\w)(?:,{G}(?:Apt|Flat|Unit){G}\d{{1,4}})?", re.I)),
)
_PERSON = rf"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]+)?(?:{G}[^\W\d_]\.)?{G}(?:[^\W\d_]\.{G})?[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]+)?(?:{G}[^\W\d_]\.(?=\W|$))?"
PERSON = re.compile(_PERSON)
_GAPS = re.compile(r"[ \t\u00a0\u2009\u202f\u200b]+")
_ODD_GAP = re.compile(r"[\t\u00a0\u2009\u202f\u200b]|  ")
_GAP = re.compile(G)
_CAP = r"(?:(?![ªº])[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻА-ЯЁІЇЄҐЎ])"
_LOW = r"(?:['’]?[^\W\d_A-ZА-ЯЁІЇЄҐЎ])+"
CAPPED = re.compile(rf"(?<![\w'’-])(?=({_CAP}{_LOW}(?:{G}{_CAP}\.)?{G}{_CAP}{_LOW}(?:-{_CAP}(?:['’]?[^\W\d_])+)?(?![\w'’-])))")
_LAST = re.compile(rf"(?<![\w'’-])({_PERSON})$")
_BARE = re.compile(r"(?:am|im|an|zum)\b", re.I)  # a name of a street without a word for street
_NUMBER = re.compile(r"\d")
_END = re.compile(r"[!?…\n]|(?<=\w\w\w\w)\.(?=\s)")
_SIGNS = ".,:;()[]\"„“”«»–—-"
SCHEMA = "id string, kind string, value string, start int, first string, last string, left string, right string, lone int, votes array<int>"
_ARROW = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()))
_FIELDS = ("id", "kind", "value", "start", "first", "last", "left", "right", "lone", "votes")


def _squeezed(low: str) -> tuple[str, list[int] | None]:
    """The text with every gap as one blank and, if that moved anything, the place of each character in the original."""
    if not _ODD_GAP.search(low):
        return low, None
    out, places = [], []
    at = 0
    for m in _GAPS.finditer(low):
        out.append(low[at : m.start()] + " ")
        places += range(at, m.start() + 1)
        at = m.end()
    out.append(low[at:])
    places += range(at, len(low) + 1)
    return "".join(out), places


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, what in words.items():
        a.add_word(w, (len(w), what))
    a.make_automaton()
    return a


_LEXICON: list[ahocorasick.Automaton] = []


def _hits(low: str, a: ahocorasick.Automaton) -> Iterator[tuple[int, int, object]]:
    """(start, end, what) of the automaton's words in the text, at beginnings of words; gaps count as single blanks."""
    plain, places = _squeezed(low)
    for end, (n, what) in a.iter(plain):
        begin = end + 1 - n
        if begin == 0 or not plain[begin - 1].isalnum():
            yield (begin, end + 1, what) if places is None else (places[begin], places[end] + 1, what)


class Sentences:
    """Where the sentences of a text are and what stands around a span in its own."""

    def __init__(self, low: str) -> None:
        self.low = low
        self.ends = [m.end() for m in _END.finditer(low)]

    def around(self, a: int, b: int) -> tuple[int, str, str]:
        """Start of the sentence, the two words before the span and the sign and two words behind it."""
        i = bisect_right(self.ends, a)
        start = self.ends[i - 1] if i else 0
        before = self.low[start:a].replace("\u200b", "").rsplit(None, 2)[-2:]
        j = bisect_right(self.ends, b)
        stop = self.ends[j] if j < len(self.ends) else len(self.low)
        behind = self.low[b:stop].replace("\u200b", "")
        sign = behind[:1] if behind[:1] in ",.;:" else ""
        words = behind[len(sign) :].split(None, 2)[:2]
        clean = [w.strip(_SIGNS) for w in before]
        left = " ".join(w or "^" for w in ["^", "^", *clean][-2:])
        return start, left, sign + " ".join(w.strip(_SIGNS + "!?…") or "$" for w in [*words, "$", "$"][:2])


def candidates(text: str) -> list[tuple[str, str, int, str, str, str, str, int, list[int]]]:
    """(kind, value, start, first and last name, left and right context, whether it is surely cut right, votes) of every span the patterns propose; names in capitals
    or after an introduction. The votes of contexts and gazetteer are still open (0)."""
    if not _LEXICON:
        _LEXICON.append(automaton({w: k for k, words in LEXICON.items() for w in words} | {w: "introduction" for w in INTRODUCTIONS}))
    low = _lowered(text)
    hits = list(_hits(low, _LEXICON[0]))
    spans: list[tuple[str, int, int, int, int]] = []  # kind, from, to, format, shape
    if "@" in text:
        spans += [("email", *m.span(), 1, 1) for m in EMAIL.finditer(text)]
    if any(w in low for w in _SPELLED_WORDS):
        taken = [x[1:3] for x in spans]
        for m in SPELLED.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                spans.append(("email", *m.span(), 1, 1 if re.search(_DOT, m.group(), re.I) or "(" in m.group() else 0))
    if _NUMBER.search(text):
        for m in IDS.finditer(text):
            value = m.group()
            spans.append(("id_number", *m.span(), 0 if value.isdigit() or value[0].islower() and not value[1].isdigit() else 1, 0))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                grouped = not m.group().isdigit()
                spans.append(("phone", *m.span(), 1 if m.group()[0] in "+(" or re.match("00[1-9]", m.group()) and len(m.group()) > 11 and not grouped else 0, 1 if grouped else 0))
        for words, pattern in ADDRESS:
            if any(w in low for w in words):
                for m in pattern.finditer(text):
                    lead = m.group().split(",")[0].split()
                    spans.append(("address", *m.span(), 0 if _BARE.match(m.group()) else 1, 1 if any(w[0].isupper() for w in lead if w[0].isalpha()) else 0))
    named = set()
    for _, end, what in hits:
        if what == "introduction":
            m = _GAP.match(text, end)
            p = PERSON.match(text, m.end()) if m else None
            if p and p.span() not in named:
                named.add(p.span())
                spans.append(("name", *p.span(), 1, _capitals(p.group())))
    pairs = [m.span(1) for m in CAPPED.finditer(text) if not any(a < m.end(1) and m.start(1) < b for a, b in named)]
    spans += [("name", *p, 0, 1) for p in pairs]
    if not spans:
        return []
    sentences, starts = Sentences(low), [x[0] for x in hits]
    # of three and more capitalised words the first may be so because it opens the sentence, and which two are a name is open
    tied = {p for p, q in pairs if any(p < r < q for r, _ in pairs)} | {r for r, _ in pairs if any(p < r < q for p, q in pairs)}
    opening = {p: not low[sentences.around(p, q)[0] : p].strip(_SIGNS + " \t\u00a0\u2009\u202f\u200b0123456789") for p, q in pairs if p in tied}
    follows = {r for p, q in pairs if opening.get(p) for r, e in pairs if p < r < q and not any(r < z < e for z, _ in pairs)}
    out = []
    for kind, a, b, form, shape in spans:
        begin, left, right = sentences.around(a, b)
        i = bisect_right(starts, a - 1) - 1
        near = hits[i][2] if i >= 0 and hits[i][0] >= begin else None
        if kind == "name":
            word = 1 if form else -1 if near == "place" else 0
        else:
            word = 0 if near in (None, "place", "introduction") else 1 if near == kind else -1
        lone = int(kind != "name" or form == 1 or a not in tied or a in follows)
        if kind == "name" and not form and opening.get(a):
            shape = 0
        out.append((kind, text[a:b], a, *_names(kind, text[a:b]), left, right, lone, [form, word, 0, 0, 0, shape]))
    return out


def _capitals(value: str) -> int:
    """1 if all full words are capitalised, 0 if all is in lower case, else -1."""
    full = [p for p in value.replace("\u200b", " ").split() if not (len(p) == 2 and p[1] == ".")]
    return 1 if all(p[0].isupper() for p in full) else 0 if value == value.lower() else -1


def _names(kind: str, value: str) -> tuple[str, str]:
    if kind != "name":
        return "", ""
    full = [p for p in value.replace("\u200b", " ").split() if not (len(p) == 2 and p[1] == ".")]
    return full[0].lower(), full[-1].lower()


def names_in_lower_case(text: str, cues: ahocorasick.Automaton, contexts: dict[str, dict[str, int]], given: frozenset[str] | None) -> list[tuple]:
    """Rows like those of ``candidates`` for names in lower case next to a promoted context.

    ``cues`` holds the promoted contexts by side. A pair of words is proposed if both its contexts are promoted or one of the words is
    a given name; where the given names are too many to be at hand (None) all pairs are proposed and held against them later.
    """
    low = _lowered(text)
    sentences = None
    seen, out = set(), []
    for begin, end, (side, key) in _hits(low, cues):
        if sentences is None:
            sentences = Sentences(low)
        if side == "left":
            m = _GAP.match(text, end)
            p = PERSON.match(text, m.end()) if m else None
            span = p.span() if p else None
        else:
            gap = begin
            while gap and text[gap - 1] in " \t\u00a0\u2009\u202f\u200b,.;:":
                gap -= 1
            line = max(low.rfind("\n", 0, gap), sentences.ends[i - 1] - 1 if (i := bisect_right(sentences.ends, gap)) else -1)
            own = text[line + 1 : gap].rsplit(None, 4)
            p = _LAST.search(text, gap - sum(map(len, own[-4:])) - 8 if len(own) > 4 else line + 1, gap)
            span = p.span(1) if p else None
        if span is None or span in seen or text[span[0] : span[1]] != low[span[0] : span[1]]:
            continue
        seen.add(span)
        _, left, right = sentences.around(*span)
        votes = contexts["left"].get(left, 0), contexts["right"].get(right, 0)
        first, last = _names("name", text[span[0] : span[1]])
        if max(votes) == 1 and (votes == (1, 1) or given is None or first in given or last in given):
            out.append(("name", text[span[0] : span[1]], span[0], first, last, left, right, 1, [0, 0, *votes, 0, 0]))
    return out


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), headless(F.col(text)).alias("text"))


def _spread_out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], names=list(_FIELDS))


def spans(df: DataFrame, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """All spans the patterns propose with their votes (columns of ``SCHEMA``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _spread_out([(k, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for c in candidates(t)])

    return map_batches(_texts(df, key, text), run, SCHEMA)


def lower_case_spans(df: DataFrame, contexts: dict[str, dict[str, int]], given: frozenset[str] | None, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """Spans of names in lower case (columns of ``SCHEMA``); the contexts have voted, the gazetteer has not."""
    shipped = df.sparkSession.sparkContext.broadcast((contexts, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, given = shipped.value
        words = {}
        for side, votes in contexts.items():
            for k, vote in votes.items():
                bare = " ".join(w for w in k.lstrip(",.;:").split() if w not in "^$")
                if vote == 1 and bare:
                    words[bare] = (side, k)
        cues = automaton(words) if words else None
        for b in batches:
            if cues is not None:
                yield _spread_out([(k, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for c in names_in_lower_case(t, cues, contexts, given)])

    return map_batches(_texts(df, key, text), run, SCHEMA)


def gazetteer(found: DataFrame, learned: bool = False) -> DataFrame:
    """(token): words of names that stand with at least ``MIN_PARTNERS`` different partners after an introduction or, if ``learned``, in promoted contexts."""
    vote = lambda name: F.col("votes")[LABELERS.index(name)]
    sure = vote("format") == 1
    if learned:
        sure = sure | (vote("left") == 1) & (vote("right") >= 0) | (vote("right") == 1) & (vote("left") >= 0)
    named = found.filter((F.col("kind") == "name") & (F.col("lone") == 1) & sure).select("first", "last").distinct()
    pairs = named.select(F.col("first").alias("token"), F.col("last").alias("other")).union(named.select(F.col("last"), F.col("first")))
    return pairs.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PARTNERS).select("token")


def _set_vote(df: DataFrame, place: int, vote) -> DataFrame:
    return df.withColumn("votes", F.transform("votes", lambda v, i: F.when(i == place, vote).otherwise(v)))


def with_gazetteer(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sets the gazetteer's vote: for a name one of whose words is listed; against one without, unless an introduction names it.

    A list of more than ``MAX_BROADCAST`` words is joined by shuffle; only names take part in that.
    """
    listed = tokens.withColumn("hit", F.lit(1))
    rest = None
    if tokens.count() <= MAX_BROADCAST:
        listed = F.broadcast(listed)
    else:
        found, rest = found.filter(F.col("kind") == "name"), found.filter(F.col("kind") != "name")
    hit = F.greatest(F.coalesce("hit_first", F.lit(0)), F.coalesce("hit_last", F.lit(0)))
    vote = F.when(F.col("kind") == "name", F.when(hit == 1, F.lit(1)).when(F.col("votes")[0] == 1, F.lit(0)).otherwise(F.lit(-1))).otherwise(F.lit(0)).cast("int")
    joined = found.join(listed.select(F.col("token").alias("first"), F.col("hit").alias("hit_first")), "first", "left").join(listed.select(F.col("token").alias("last"), F.col("hit").alias("hit_last")), "last", "left")
    voted = _set_vote(joined, GAZETTEER, vote).drop("hit_first", "hit_last").select(found.columns)
    return voted if rest is None else voted.unionByName(rest.select(found.columns))


def learned_contexts(found: DataFrame) -> dict[str, dict[str, dict[str, int]]]:
    """Per kind and side the contexts that vote, with their vote.

    Different values are counted, each once, so neither a value said often nor a heavy user decides. What comes back are phrases that
    recur around personal information, a vocabulary and not rows; over ``MAX_CONTEXTS`` of them are refused.
    """
    sure = (F.col("votes")[0] == 1) | (F.col("votes")[1] == 1) | (F.col("votes")[GAZETTEER] == 1)
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("key")), F.struct(F.lit("right").alias("side"), F.col("right").alias("key")))).alias("c")
    each = found.filter("lone = 1").select("kind", F.lower("value").alias("value"), sure.cast("int").alias("sure"), sides).groupBy("kind", "c.side", "c.key", "value").agg(F.max("sure").alias("sure"))
    counted = each.groupBy("kind", "side", "key").agg(F.count("*").alias("n"), F.sum("sure").alias("sure"))
    pro = (F.col("n") >= MIN_VALUES) & (F.col("sure") >= SURE_SHARE * F.col("n"))
    con = (F.col("n") >= MIN_DOUBTED) & (F.col("sure") <= DOUBTED_SHARE * F.col("n"))
    rows = counted.filter(pro | con).select("kind", "side", "key", F.when(pro, 1).otherwise(-1).alias("vote")).limit(MAX_CONTEXTS + 1).collect()
    if len(rows) > MAX_CONTEXTS:
        raise ValueError(f"over {MAX_CONTEXTS} contexts")
    out = {k: {"left": {}, "right": {}} for k in KINDS}
    for r in rows:
        if r["key"] not in ("^ ^", "$ $", ".$ $", ",$ $"):
            out[r["kind"]][r["side"]][r["key"]] = r["vote"]
    return out


def with_contexts(found: DataFrame, contexts: dict[str, dict[str, dict[str, int]]]) -> DataFrame:
    """Sets the votes of the left and right contexts."""
    out = found
    for side, place in (("left", LEFT), ("right", RIGHT)):
        rows = [(kind, key, vote) for kind, sides in contexts.items() for key, vote in sides[side].items()]
        table = found.sparkSession.createDataFrame(rows, f"kind string, {side} string, _vote int")
        table = F.broadcast(table) if len(rows) <= MAX_BROADCAST else table
        out = _set_vote(out.join(table, ["kind", side], "left"), place, F.coalesce("_vote", F.lit(0))).select(found.columns)
    return out


def learn(counts: dict[tuple[str, tuple[int, ...]], int]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes) pattern being a true span, from the counts of the patterns alone."""
    out = {}
    for kind in KINDS:
        own = [(votes, n) for (k, votes), n in sorted(counts.items()) if k == kind]
        if not own:
            continue
        votes = np.array([v for v, _ in own], dtype=float)
        n = np.array([c for _, c in own], dtype=float)
        p = 1 / (1 + np.exp(-votes.sum(1) * 1.5 + 1.0))
        for _ in range(ROUNDS):
            # of each labeler: how often it says +1, 0, -1 on true and on other spans (smoothed)
            log_odds = np.log((n @ p + 2) / (n @ (1 - p) + 2)) * np.ones(len(n))
            for j in range(votes.shape[1]):
                for x in (-1, 0, 1):
                    own_rows = votes[:, j] == x
                    yes = (n[own_rows] @ p[own_rows] + 1) / (n @ p + 3)
                    no = (n[own_rows] @ (1 - p[own_rows]) + 1) / (n @ (1 - p) + 3)
                    # a labeler may be unreliable but is never taken to mean the opposite of what it says
                    ratio = np.log(yes / no)
                    log_odds[own_rows] += max(0.0, ratio) if x > 0 else min(0.0, ratio) if x < 0 else np.clip(ratio, -1.5, 0.5)
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        weights = _logistic(votes, p, n)
        for v, q in zip(votes, _predict(weights, votes)):
            out[kind, tuple(int(x) for x in v)] = float(q)
    return out


def _features(votes: np.ndarray) -> np.ndarray:
    return np.hstack([votes > 0, votes < 0, np.ones((len(votes), 1))]).astype(float)


def _predict(weights: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(votes) @ weights, -30, 30)))


def _logistic(votes: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier fitted to soft labels by Newton steps."""
    x, w = _features(votes), np.zeros(votes.shape[1] * 2 + 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (q - p)) + ridge * w
        bend = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def model(found: DataFrame) -> dict[tuple[str, tuple[int, ...]], float]:
    counted = found.groupBy("kind", "votes").count()
    return learn({(r["kind"], tuple(r["votes"])): r["count"] for r in counted.collect()})


def judged(df: DataFrame, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """Every proposed span with ``probability``; spans that overlap a likelier one of the transcript are still in.

    The jobs that propose spans and learn contexts and names run when this is called; the texts are read twice.
    """
    first = stash(spans(df, key, text), "spans")
    introduced = with_gazetteer(first, stash(gazetteer(first), "names"))
    contexts = learned_contexts(introduced)
    second = with_contexts(first, contexts)
    tokens = stash(gazetteer(second, learned=True), "names")
    given = tokens.limit(MAX_BROADCAST + 1).collect()
    given = frozenset(r[0] for r in given) if len(given) <= MAX_BROADCAST else None
    lower = stash(lower_case_spans(df, contexts["name"], given, key, text), "lower")
    both = F.col("votes")[LEFT] + F.col("votes")[RIGHT] == 2
    found = with_gazetteer(second, tokens).unionByName(with_gazetteer(lower, tokens).filter(both | (F.col("votes")[GAZETTEER] == 1)))
    learned = model(found)
    table = df.sparkSession.createDataFrame([(k, list(v), p) for (k, v), p in learned.items()], "kind string, votes array<int>, probability double")
    return found.join(F.broadcast(table), ["kind", "votes"])


def personal_information(df: DataFrame, key: str = "id", text: str = "transcription_text", threshold: float = 0.5) -> DataFrame:
    """(id, kind, value): each piece of personal information of each transcript, once. Of overlapping spans the likelier stays."""
    return resolved(judged(df, key, text).filter(F.col("probability") >= threshold)).select("id", "kind", "value").distinct()


def resolved(likely: DataFrame) -> DataFrame:
    """The spans that stay: from the likeliest on, of equal ones from the longer, each that overlaps none that stays.

    Spans that hang together by overlaps are settled together; a transcript's other spans do not come into it.
    """
    order = Window.partitionBy("id").orderBy("start", "end", "kind", "value")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = likely.withColumn("end", F.col("start") + F.length("value"))
    apart = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True))
    chained = ends.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.struct("probability", F.length("value").alias("n"), F.reverse("kind").alias("turned"), (-F.col("start")).alias("early"), "start", "end", "kind", "value")
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))))
    grouped = chained.groupBy("id", "chain").agg(F.sort_array(F.collect_list(span), asc=False).alias("spans"))
    return grouped.select("id", F.explode(kept).alias("s")).select("id", "s.kind", "s.value", "s.start", "s.probability")


_LINE = re.compile(r"\r\n?|\n")


def replaced(text: str, bare: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with a placeholder at each (start, length, kind) of ``bare``, which is ``text`` without what ``headless`` takes off its lines."""
    ends = [m.start() for m in _LINE.finditer(text)] + [len(text)]
    lines = bare.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out, done = [], 0
    for start, size, kind in sorted(found):
        i = bisect_right(starts, start) - 1
        a = ends[i] - (starts[i] + len(lines[i]) - start)
        out += [text[done:a], f"[{kind.upper()}]"]
        done = a + size
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, key: str = "id", text: str = "transcription_text", threshold: float = 0.5) -> DataFrame:
    """(id, text): each distinct transcript with typed placeholders such as ``[EMAIL]`` in place of personal information.

    Spans are cut out by their places, so a name inside a longer word or a number inside a longer one stays. Rows of one id with
    different texts count as one, the least text.
    """
    # spans are found per id and text on the table as it is; the texts move once, to become one a transcript
    base = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    rows = base.groupBy("id").agg(F.min("text").alias("text"))
    mark = F.hex(F.xxhash64("text"))
    named = base.filter(F.col("text").isNotNull()).select(F.concat_ws("\x1f", "id", mark).alias("id"), "text")
    likely = resolved(judged(named, "id", "text").filter(F.col("probability") >= threshold)).withColumn("of", F.substring_index("id", "\x1f", -1))
    span = F.struct("start", F.length("value").alias("size"), "kind", "of")
    places = likely.select(F.expr("left(id, length(id) - length(of) - 1)").alias("id"), span.alias("span")).groupBy("id").agg(F.collect_set("span").alias("found"))
    own = F.filter("found", lambda f: f["of"] == mark)
    joined = rows.join(places, "id", "left").select("id", "text", headless(F.col("text")).alias("bare"), own.alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, bares, found = (c.to_pylist() for c in b.columns)
            done = [replaced(t, x, [(f["start"], f["size"], f["kind"]) for f in own]) if own and t else t for t, x, own in zip(texts, bares, found)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(done, pa.string())], names=["id", "text"])

    return map_batches(joined, run, "id string, text string")
