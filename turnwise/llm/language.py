"""The language of each transcript and of each stretch of a mixed one, with a confidence.

Method: string-kernel classification. A text is the set of character n-grams (3 to 5, blended) of its padded words; the
kernel of two texts is the number of n-grams they share over the root of the product of their set sizes (presence, not
counts). Reference sentences serve as Nyström landmarks; one-versus-rest kernel ridge regression is fitted on the Nyström
features. As the kernel is linear in presence, the fitted machine folds into one weight per n-gram and language, and a
word's scores are the presence row of its n-grams times that matrix; words of a batch are scored in one product, and
sentences by adding their words' rows.

A text or stretch whose longer n-grams hardly occur in the references is in none of their languages (``UNKNOWN``); its confidence
is the share of n-grams that do not occur. Close relatives of a fitted language are not told apart from it so.

Cyrillic references are also used in Latin transliteration, so a language is told in whatever script it is written.
The labelled sample is bounded by ``MAX_REFERENCES``; all texts are scored whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.markup import distinct_rows, fence, parts, spoken
from turnwise.llm.quality import common_hashes, junk
from turnwise.session import map_batches

MAX_REFERENCES = 20_000
LANDMARKS = 400
RIDGE = 0.1
GRAMS = (3, 4, 5)
RUN_WORDS = 12  # a stretch without sentence ends is judged in runs of so many words
SHARPNESS = 4.0
PRIOR_WORDS = 2.5
REPEAT_WEIGHT = 0.2
SURE = 0.5
UNKNOWN = "und"
KNOWN_TEXT, KNOWN_STRETCH, KNOWN_WORDS = 0.1, 0.05, 8  # shares of known n-grams of four and more; from so many different words on
MIN_WORDS = 15
MIN_SHARE = 0.15
TOKEN = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*|[.!?…\n]")
CACHE_WORDS = 400_000

# fixed values: Latin spellings of Cyrillic letters; later columns are other usual spellings
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "ye", "ё": "yo", "ж": "zh", "з": "z", "и": "i",
    "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ў": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "yu", "я": "ya",
}
LATIN_UK = {"г": "h", "и": "y", "щ": "shch"}
LATIN_BE = {"г": "h", "ў": "w"}


def latin(text: str, lang: str) -> str:
    table = LATIN | {"uk": LATIN_UK, "be": LATIN_BE}.get(lang, {})
    return "".join(table.get(c, c) for c in text.lower())


def grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)} or {padded}


def text_grams(text: str) -> set[str]:
    return set().union(*(grams(w) for w in TOKEN.findall(text.lower()) if w[0].isalpha())) if text else set()


def fit(references: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Fits the machine on (lang, text) pairs.

    Gives ``langs``, ``grams`` (n-gram to row), ``weights`` (a row a gram, a column a language) and ``name``, a hash of them.
    Only n-grams of landmarks carry weight, so memory goes with references x landmarks and the landmarks' n-grams.
    """
    pairs = sorted({(lang, text) for lang, text in references if lang and text and text.strip()})
    pairs += [(lang, latin(text, lang)) for lang, text in pairs if re.search("[Ѐ-ӿ]", text)]
    sets = [(lang, g) for lang, text in pairs if (g := text_grams(text))]
    langs = sorted({lang for lang, _ in sets})
    if len(langs) < 2:
        raise ValueError("references of at least two languages are needed")
    chosen = np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))
    marks = [sets[i][1] for i in chosen]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*marks)))}
    holders: list[list[int]] = [[] for _ in vocabulary]
    for j, own in enumerate(marks):
        for g in own:
            holders[vocabulary[g]].append(j)
    norms = np.sqrt([len(own) for own in marks])
    kernel = np.zeros((len(sets), len(marks)))
    for row, (_, own) in enumerate(sets):
        shared = [j for g in own if g in vocabulary for j in holders[vocabulary[g]]]
        kernel[row] = np.bincount(np.array(shared, dtype=np.int64), minlength=len(marks)) / (norms * np.sqrt(len(own)))
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.where(np.array([[lang == x for x in langs] for lang, _ in sets]), 1.0, -1.0)
    weight = 1 / np.sqrt(np.maximum(1, (target > 0).sum(0)))  # languages count alike however many references they have
    sample = np.sqrt((weight * (target > 0)).sum(1, keepdims=True))
    f, y = features * sample, target * sample
    beta = np.linalg.solve(f.T @ f + ridge * np.eye(f.shape[1]), f.T @ y)
    of_mark = (root @ beta) / norms[:, None]
    folded = np.array([of_mark[own].sum(0) for own in holders], dtype=np.float32)
    folded -= folded.mean(1, keepdims=True)
    name = hashlib.blake2b("\x00".join([*langs, *vocabulary]).encode() + folded.tobytes(), digest_size=16).hexdigest()
    return {"langs": langs, "grams": vocabulary, "weights": folded, "name": name}


class Scorer:
    """Word scores of one fitted machine; words seen before are looked up."""

    def __init__(self, model: dict) -> None:
        self.langs, self.grams = model["langs"], model["grams"]
        self.weights = np.vstack((model["weights"], np.zeros((1, len(self.langs)), dtype=np.float32)))  # the last row stands for unknown grams
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {x: 0 for x in ".!?…\n"}
        self.rows = np.zeros((1, len(self.langs)), dtype=np.float32)
        self.known = np.zeros((1, 2))  # n-grams of four and more of each word: in the references, and all

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.codes.keys())
        if not new:
            return
        # the presence rows of the new words times the weights, as one sparse product
        unknown, cells, starts, sizes, known = len(self.weights) - 1, [], [], [], []
        for w in new:
            own = grams(w)
            starts.append(len(cells))
            sizes.append(len(own))
            cells += [self.grams.get(g, unknown) for g in own]
            longer = [g in self.grams for g in own if len(g) > 3]
            known.append((sum(longer), len(longer)))
        scores = np.add.reduceat(self.weights[cells], starts, axis=0) / np.sqrt(np.array(sizes, dtype=np.float32))[:, None]
        self.codes.update((w, len(self.rows) + i) for i, w in enumerate(new))
        self.rows = np.vstack((self.rows, scores.astype(np.float32)))
        self.known = np.vstack((self.known, np.array(known, dtype=float)))

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """``_stretches`` of a batch, taken in parts."""
        found = []
        for part in parts(texts):
            doc, *rest = self._stretches(texts[part])
            found.append((doc + part.start, *rest))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _stretches(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of each stretch of one language: text number, language number, confidence, words. The number after the last stands for none of them."""
        if len(self.codes) > CACHE_WORDS:
            self.reset()
        tokens: list[str] = []
        lengths = []
        for t in texts:
            own = TOKEN.findall(t.lower()) if t else []
            own.append("\n")
            tokens += own
            lengths.append(len(own))
        self.learn(set(tokens))
        codes = np.fromiter(map(self.codes.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        doc = np.repeat(np.arange(len(texts)), lengths)
        group = np.cumsum(codes == 0)
        word = codes > 0
        codes, doc, group = codes[word], doc[word], group[word]
        if not len(codes):
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        at = np.arange(len(codes))
        start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
        begins = np.flatnonzero((at - start) % RUN_WORDS == 0)
        n = np.diff(np.r_[begins, len(codes)])
        # presence: a word said again in the same text hardly adds evidence
        fresh = np.zeros(len(codes), dtype=bool)
        fresh[np.unique(doc * len(self.rows) + codes, return_index=True)[1]] = True
        weight = np.where(fresh, np.float32(1), np.float32(REPEAT_WEIGHT))
        scores = self.rows[codes] * weight[:, None]
        sums = np.add.reduceat(scores, begins, axis=0)
        evidence = np.add.reduceat(weight, begins)
        seg_doc = doc[begins]
        means = sums / evidence[:, None]
        same = seg_doc[1:] == seg_doc[:-1]
        near = np.zeros_like(means)  # a stretch of little evidence leans on its neighbours, and all a little on the whole text
        near[1:][same] += means[:-1][same]
        near[:-1][same] += means[1:][same]
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        whole = np.add.reduceat(scores * fresh[:, None], heads, axis=0) / np.add.reduceat(fresh.astype(np.float32), heads)[:, None]
        firsts = np.flatnonzero(np.r_[True, ~same])
        sums = np.where((evidence < 4)[:, None], sums + near, sums) + PRIOR_WORDS * np.repeat(whole, np.diff(np.r_[firsts, len(n)]), axis=0)
        lang = sums.argmax(1)
        e = np.exp(SHARPNESS * (sums - sums.max(1, keepdims=True)) / np.sqrt(evidence)[:, None])
        confidence = 1 / e.sum(1)
        lang = self._settled(seg_doc, lang, confidence, n)
        first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | ~same])
        words = np.add.reduceat(n, first)
        known = self.known[codes] * fresh[:, None]
        of_text = np.add.reduceat(known, heads, axis=0)
        of_stretch = np.add.reduceat(known, begins[first], axis=0)
        different = fresh.astype(np.int64)
        foreign = ((of_text[:, 0] < KNOWN_TEXT * of_text[:, 1]) & (np.add.reduceat(different, heads) >= KNOWN_WORDS))[np.searchsorted(doc[heads], seg_doc[first])]
        foreign |= (np.add.reduceat(different, begins[first]) >= KNOWN_WORDS) & (of_stretch[:, 0] < KNOWN_STRETCH * of_stretch[:, 1])
        share = np.add.reduceat(confidence * n, first) / words
        unsure = 1 - of_stretch[:, 0] / np.maximum(of_stretch[:, 1], 1)
        return seg_doc[first], np.where(foreign, len(self.langs), lang[first]), np.where(foreign, unsure, share), words


    def _settled(self, doc: np.ndarray, lang: np.ndarray, confidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A further language of a text stands only if it is, on the whole, told with confidence; else it is the main one's."""
        k, last = len(self.langs), int(doc[-1]) + 1
        cell = doc * k + lang
        words = np.bincount(cell, weights=n, minlength=last * k).reshape(last, k)
        mean = np.bincount(cell, weights=n * confidence, minlength=last * k).reshape(last, k) / np.maximum(words, 1)
        main = (words * np.maximum(mean - 0.25, 1e-6)).argmax(1)
        return np.where((mean.ravel()[cell] < SURE) & (lang != main[doc]), main[doc], lang)


_SCORERS: dict[str, Scorer] = {}


def scorer(key: str, model: dict) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


SCHEMA = "id string, n_words bigint, stretches array<struct<lang: string, confidence: double, n_words: bigint>>"
_STRETCH = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int64())])


def references(spark: SparkSession, reference_path: str, words_path: str | None = None) -> list[tuple[str, str]]:
    """Labelled texts: the sentences of one table (lang, text) and, as one text a language, the words of another (lang, word).

    Beyond ``MAX_REFERENCES`` sentences a fixed pseudo-random sample of them is used, the same one on every run.
    """
    sentences = spark.read.parquet(reference_path).select("lang", "text").distinct()
    rows = [tuple(r) for r in sentences.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(MAX_REFERENCES).collect()]
    if words_path:
        rows += [tuple(r) for r in spark.read.parquet(words_path).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("word")), " ")).collect()]
    return rows


def label_languages(df: DataFrame, model: dict, key: str = "id", text: str = "_spoken", common: Iterable[str] | None = None) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words`` and the ``stretches`` in order (lang, confidence, n_words).

    With ``common`` words given, lists, tables and junk (``quality.junk``) count as texts without words. A null, empty or wordless text has 0 words and no stretch. Extra columns are ignored. The confidence is the softmax of
    the language scores of the stretch, weighted by words.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    name = model["name"]
    known = None if common is None else common_hashes(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(name, shipped.value)
        langs = pa.array([*s.langs, UNKNOWN])
        for b in batches:
            texts = b.column(1).to_pylist()
            if known is not None:
                texts = [None if bad else t for t, bad in zip(texts, junk(texts, known))]
            doc, lang, confidence, words = s.stretches(texts)
            n = b.num_rows
            offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            parts = pa.StructArray.from_arrays([langs.take(pa.array(lang)), pa.array(confidence, pa.float64()), pa.array(words, pa.int64())], fields=list(_STRETCH))
            total = np.bincount(doc, weights=words, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), parts)], names=["id", "n_words", "stretches"])

    return map_batches(df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")), run, SCHEMA)


def language_words(labelled: DataFrame) -> DataFrame:
    """Adds ``spoken``: the languages that hold at least ``MIN_SHARE`` of the words, by falling words; the first is the main one."""
    tally = F.aggregate(
        "stretches",
        F.create_map().cast("map<string,bigint>"),
        lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["lang"]), F.create_map(s["lang"], F.coalesce(F.element_at(m, s["lang"]), F.lit(0)) + s["n_words"])),
    )
    by = F.sort_array(F.transform(F.map_entries("_tally"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("lang"))), asc=False)
    return (
        labelled.withColumn("_tally", tally)
        .withColumn("_by", by)
        .withColumn("spoken", F.transform(F.filter("_by", lambda e: e["n"] >= MIN_SHARE * F.col("n_words")), lambda e: e["lang"]))
        .drop("_tally", "_by")
    )


def mislabelled(transcripts: DataFrame, features: DataFrame, model: dict, common: list[str]) -> DataFrame:
    """(id, lang): languages of transcripts whose recorded label is missing or wrong or that speak several languages.

    Only transcripts of at least ``MIN_WORDS`` spoken words that are not lists, tables or junk. The recorded label agrees
    if it is the main language's code, letter case and a region suffix aside. Repeated deliveries and feature rows count once.
    """
    said = transcripts.select("id", spoken(F.col("transcription_text")).alias("_spoken"))
    labelled = distinct_rows(fence(language_words(label_languages(said, model, common=common).filter(F.col("n_words") >= MIN_WORDS))).select("id", "spoken"), "id")
    code = F.lower(F.regexp_extract(F.trim("layer_b_primary_language"), r"^(\p{L}+)(?:[-_].*)?$", 1))
    recorded = features.groupBy("id").agg(F.max(code).alias("code"))
    labelled = labelled.withColumn("spoken", F.array_remove("spoken", UNKNOWN))
    right = (F.size("spoken") == 1) & (F.col("spoken")[0] == F.coalesce("code", F.lit("")))
    return labelled.join(recorded, "id", "left").filter(~right).select("id", F.explode("spoken").alias("lang"))


def document_languages(labelled: DataFrame) -> DataFrame:
    """(id, lang, confidence, n_words): the main language of each transcript, confidence weighted by its words' share; null without words."""
    main = language_words(labelled).withColumn("lang", F.get("spoken", F.lit(0)))
    own = F.filter("stretches", lambda s: s["lang"] == F.col("lang"))
    mass = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"] * s["n_words"])
    return main.select("id", "lang", F.when(F.col("n_words") > 0, mass / F.col("n_words")).alias("confidence"), "n_words")


def segments(labelled: DataFrame) -> DataFrame:
    """(id, seg_no, lang, confidence, n_words): the stretches of each transcript, numbered from 1."""
    return labelled.select("id", F.posexplode("stretches")).select("id", (F.col("pos") + 1).alias("seg_no"), "col.*")
