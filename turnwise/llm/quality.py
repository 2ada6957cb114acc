"""Per-document text quality statistics and the rules that tell speech from lists, tables and junk.

Method: the texts of a batch are laid out as one array of code points; words, lines and their lengths, symbols, sentence
ends, list marks, column separators and common words are counted with array operations, without a loop over rows, lines or
words. Fixed thresholds on these statistics decide, and each rule that fires is recorded by name.

Rules of two kinds (``RULES`` states them all):

* the thresholds published for the Gopher corpus (50 to 100,000 words, mean word length 3 to 10, symbol-to-word ratio at most
  0.1, at most 90 % bullet lines, at most 30 % lines ending in an ellipsis, at least 80 % of words with a letter, at least 2
  stop words). They are recorded but do not reject, as a short reply or a single utterance is speech and fails several;
* the same kind of threshold on how much of the text (by visible characters) stands in lines that are list items, table rows or
  codes, and on words without syllables or broken up by signs. A document that fails one of these is a case (``junk``).

A line is a list item if it starts with a list mark, has no sentence end and is short or holds few common and few repeated
words, or if it is one of many short lines without marks and sentence ends; a table row if it has two column separators of one kind, however
long its cells are; a code if letters are less than half of what is visible beside times or most of it is words of 40 characters and more.

Null, empty and blank texts have zero counts, null ratios, no junk and the reason ``empty``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.markup import parts, spoken
from turnwise.session import map_batches

MAX_COMMON_WORDS = 10_000

# fixed values: the published thresholds
MIN_WORDS, MAX_WORDS = 50, 100_000
WORD_LENGTH = (3, 10)
SYMBOLS_A_WORD = 0.1
BULLET_LINES = 0.9
ELLIPSIS_LINES = 0.3
LETTERED_WORDS = 0.8
STOP_WORDS = 2

# thresholds of what is no speech
MOST = 0.5
ITEM_WORDS = 6
ITEM_COMMON = 0.34
DISTINCT_WORDS = 0.7
UNMARKED_LINES = 6
SEPARATORS = 2
WIDE_GAP = 3
CELL_WORDS = 3  # on average at most so many words a cell between wide gaps, half of that between commas
CODE_CHARS = 8
LONG_TOKEN = 40
WORDLESS_COMMON = 0.05
WORDLESS_TOKENS = 8
CLUSTERS_A_WORD = 0.18
TOKENS_A_WORD = 2

# letters that do not form syllables: five consonants in a row, or a word that starts with a sign
CLUSTER = re.compile(r"[бвгджзйклмнпрстфхцчшщъь]{5,}|(?<![^\W\d_])[ьъы]|[bcdfghjklmnpqrstvwxz]{5,}")
BULLETS = "-•*–·▪"
SENTENCE_ENDS = ".!?…"
CLOSERS = "\"»”')]"

_SIZE = 0x30000
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below ``_SIZE``; made once per worker."""
    if not _TABLES:
        kinds = {"L": _LETTER, "M": _LETTER, "N": _DIGIT, "Z": _SPACE}
        chars = [chr(i) for i in range(_SIZE)]
        _TABLES.append(np.array([_SPACE if c.isspace() else kinds.get(unicodedata.category(c)[0], _SYMBOL) for c in chars], dtype=np.uint8))
        _TABLES.append(np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32))
    return _TABLES[0], _TABLES[1]


_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x9E3779B97F4A7C15, dtype=np.uint64)])


def word_hash(word: str) -> int:
    codes = np.array([ord(c) for c in word.lower()][: len(_POWERS)], dtype=np.uint64)
    return int((codes * _POWERS[: len(codes)]).sum(dtype=np.uint64))


def common_hashes(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in words if w], dtype=np.uint64))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True; the last element must be False."""
    steps = np.diff(np.concatenate(([False], mask)).view(np.int8))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


FIELDS = ("n_words", "visible", "symbols", "marks", "n_lines", "punctuated", "bullets", "ellipses", "lettered", "tokens", "n_common", "in_items", "in_rows", "in_codes", "clusters")


def count(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    """The counts (``FIELDS``) of each text. ``common`` comes from ``common_hashes``; line ends are ``\\n``."""
    found = [_count(texts[part], common) for part in parts(texts)]
    return {f: np.concatenate([c[f] for c in found]) for f in FIELDS}


def _count(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    kind_of, lower_of = _tables()
    docs = len(texts)
    if not docs:
        return {f: np.zeros(0, np.int64) for f in FIELDS}
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=docs)
    code = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(code, _SIZE - 1)
    kind = kind_of[small]
    seen = kind > _SPACE
    line_end = np.flatnonzero(code == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    doc_start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    line_doc = np.searchsorted(doc_start, line_start, "right") - 1
    lines = len(line_end)
    of_line = lambda mask: np.bincount(np.searchsorted(line_end, np.flatnonzero(mask)), minlength=lines)
    of_doc = lambda weights: np.bincount(line_doc, weights=weights, minlength=docs).astype(np.int64)

    # words between white space
    begin, end = _runs(seen)
    word_line = np.searchsorted(line_end, begin)
    words = np.bincount(word_line, minlength=lines)
    length = end - begin
    visible = np.bincount(word_line, weights=length, minlength=lines).astype(np.int64)
    sums = lambda k: np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))
    letters, digits = sums(_LETTER), sums(_DIGIT)
    line_letters = letters[line_end] - letters[line_start]
    line_digits = digits[line_end] - digits[line_start]
    lettered = np.bincount(word_line, weights=letters[end] > letters[begin], minlength=lines)

    # runs of letters, and which of them are common words
    a, b = _runs(kind == _LETTER)
    size = b - a
    inside = np.flatnonzero(kind == _LETTER)
    place = np.minimum(inside - np.repeat(a, size), len(_POWERS) - 1)
    hashes = np.add.reduceat(lower_of[small[inside]].astype(np.uint64) * _POWERS[place], np.cumsum(np.r_[0, size[:-1]])) if len(a) else np.zeros(0, np.uint64)
    at = np.searchsorted(common, hashes)
    is_common = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == hashes) if len(common) else np.zeros(len(a), bool)
    token_line = np.searchsorted(line_end, a)
    tokens = np.bincount(token_line, minlength=lines)
    line_common = np.bincount(token_line[is_common], minlength=lines)

    # the first and last word of each line
    full = words > 0
    first = np.minimum(np.searchsorted(begin, line_start), max(0, len(begin) - 1))
    last = np.maximum(np.searchsorted(begin, line_end) - 1, 0)
    if len(begin):
        head, head_end, tail = begin[first], end[first], end[last] - 1
        closed = np.isin(code[tail], [ord(c) for c in CLOSERS]) & (tail > line_start)
        stop = np.where(closed, code[tail - 1], code[tail])
        sentence = full & np.isin(stop, [ord(c) for c in SENTENCE_ENDS])
        ellipsis = full & ((code[tail] == ord("…")) | (tail >= 2) & (code[tail] == 46) & (code[np.maximum(tail - 1, 0)] == 46) & (code[np.maximum(tail - 2, 0)] == 46))
        numbered = np.isin(code[head_end - 1], [46, 41]) & (digits[head_end] - digits[head] == head_end - head - 1) & (head_end - head >= 2) & (head_end - head <= 4)
        marked = full & (words > 1) & ((head_end - head == 1) & np.isin(code[head], [ord(c) for c in BULLETS]) | numbered)
        braced = full & (code[head] == ord("{")) & (code[tail] == ord("}"))
    else:
        sentence = ellipsis = marked = braced = np.zeros(lines, bool)

    # column separators
    after = np.concatenate((seen[1:], [False]))
    before = np.concatenate(([False], seen[:-1]))
    loose = of_line((code == 44) & ~after)
    tight = of_line((code == 44) & after & before)
    gaps = np.bincount(word_line[1:][(word_line[1:] == word_line[:-1]) & (begin[1:] - end[:-1] >= WIDE_GAP)], minlength=lines) if len(begin) else np.zeros(lines, np.int64)
    rows = (of_line(code == ord("|")) >= SEPARATORS) | (of_line((code == 9)) >= SEPARATORS) & full | (of_line((code == ord(";")) & after) >= SEPARATORS)
    rows |= (tight >= SEPARATORS) & (loose == 0) & (2 * words <= CELL_WORDS * (tight + 1)) | (gaps >= SEPARATORS) & (words <= CELL_WORDS * (gaps + 1)) & ~sentence

    # codes, items and unmarked items
    long = np.bincount(word_line, weights=np.where(length >= LONG_TOKEN, length, 0), minlength=lines)
    colons = np.concatenate(([0], np.cumsum(code == 58, dtype=np.int64)))
    clock = (letters[end] == letters[begin]) & (colons[end] > colons[begin]) & (digits[end] > digits[begin])  # times of unknown layouts are no code
    timeless = visible - np.bincount(word_line, weights=np.where(clock, length, 0), minlength=lines).astype(np.int64)
    codes = ~rows & full & (braced | (timeless >= CODE_CHARS) & (2 * line_letters < timeless) | (2 * long >= visible))
    ended = of_line(np.isin(code, [ord(c) for c in SENTENCE_ENDS]) & ~after)
    long_item = marked & (words > ITEM_WORDS + 1) & (line_common < ITEM_COMMON * tokens) & (ended <= 1)
    own = long_item[token_line] if len(a) else np.zeros(0, bool)
    pairs = np.unique(np.stack((token_line[own].astype(np.uint64), hashes[own])), axis=1)[0].astype(np.int64) if own.any() else np.zeros(0, np.int64)
    long_item &= np.bincount(pairs, minlength=lines) >= DISTINCT_WORDS * tokens
    items = marked & ~sentence & ~rows & ~codes & ((words <= ITEM_WORDS + 1) | long_item)
    pauses = of_line(np.isin(code, [ord(c) for c in SENTENCE_ENDS + ","]))
    follows = np.concatenate(([False], full[:-1] & (line_doc[1:] == line_doc[:-1])))
    plain = full & follows & ~marked & ~rows & ~codes & (words <= ITEM_WORDS) & (pauses == 0)
    many = of_doc(plain)[line_doc] >= UNMARKED_LINES
    items |= plain & many

    dots = _runs(code == 46)
    marks = of_line((code == ord("#")) | (code == ord("…"))) + np.bincount(np.searchsorted(line_end, dots[0]), weights=(dots[1] - dots[0]) // 3, minlength=lines)
    out = {
        "n_words": of_doc(words), "visible": of_doc(visible), "symbols": of_doc(visible - line_letters - line_digits), "marks": of_doc(marks), "n_lines": of_doc(full), "punctuated": of_doc(sentence),
        "bullets": of_doc(marked), "ellipses": of_doc(ellipsis), "lettered": of_doc(lettered), "tokens": of_doc(tokens), "n_common": of_doc(line_common),
        "in_items": of_doc(np.where(items, visible, 0)), "in_rows": of_doc(np.where(rows, visible, 0)), "in_codes": of_doc(np.where(codes, visible, 0)),
    }
    clusters = np.zeros(docs, np.int64)
    for i in np.flatnonzero((out["tokens"] >= WORDLESS_TOKENS) & (out["n_common"] < WORDLESS_COMMON * out["tokens"])):
        clusters[i] = len(CLUSTER.findall(texts[i].lower()))
    return out | {"clusters": clusters}


def _over(a, b, share: float) -> np.ndarray:
    return a > share * b


# rules by name, on the counts; the second table holds those that make a document a case
RULES = {
    "empty": lambda c: c["n_words"] == 0,
    "too_few_words": lambda c: (c["n_words"] > 0) & (c["n_words"] < MIN_WORDS),
    "too_many_words": lambda c: c["n_words"] > MAX_WORDS,
    "word_length": lambda c: (c["n_words"] > 0) & ((c["visible"] < WORD_LENGTH[0] * c["n_words"]) | (c["visible"] > WORD_LENGTH[1] * c["n_words"])),
    "symbols": lambda c: _over(c["marks"], c["n_words"], SYMBOLS_A_WORD),
    "bullets": lambda c: _over(c["bullets"], c["n_lines"], BULLET_LINES),
    "ellipses": lambda c: _over(c["ellipses"], c["n_lines"], ELLIPSIS_LINES),
    "no_letters": lambda c: c["lettered"] < LETTERED_WORDS * c["n_words"],
    "no_common_words": lambda c: (c["n_words"] > 0) & (c["n_common"] < STOP_WORDS),
}
CASES = {
    "list_items": lambda c: _over(c["in_items"], c["visible"], MOST),
    "table_rows": lambda c: _over(c["in_rows"], c["visible"], MOST),
    "codes": lambda c: _over(c["in_codes"], c["visible"], MOST),
    "items_rows_and_codes": lambda c: _over(c["in_items"] + c["in_rows"] + c["in_codes"], c["visible"], MOST),
    "broken_words": lambda c: (c["tokens"] >= WORDLESS_TOKENS) & (c["n_common"] < WORDLESS_COMMON * c["tokens"]) & (c["tokens"] > TOKENS_A_WORD * c["n_words"]),
    "no_syllables": lambda c: (c["tokens"] >= WORDLESS_TOKENS) & (c["n_common"] < WORDLESS_COMMON * c["tokens"]) & (c["clusters"] > CLUSTERS_A_WORD * c["tokens"]),
}


def junk(texts: list[str | None], common: np.ndarray) -> np.ndarray:
    """Whether each text (without markup) is a list, a table or junk: one of ``CASES`` fires."""
    c = count(texts, common)
    return np.logical_or.reduce([rule(c) for rule in CASES.values()])


def common_words(spark: SparkSession, path: str) -> list[str]:
    """The words of the table at ``path`` (columns lang, word); a table over ``MAX_COMMON_WORDS`` words is refused."""
    rows = spark.read.parquet(path).select(F.lower("word")).distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"over {MAX_COMMON_WORDS} common words")
    return sorted(r[0] for r in rows if r[0])


RATIOS = {
    "mean_word_length": ("visible", "n_words"),
    "symbol_ratio": ("symbols", "visible"),
    "punctuated_share": ("punctuated", "n_lines"),
    "bullet_share": ("bullets", "n_lines"),
    "ellipsis_share": ("ellipses", "n_lines"),
    "letter_share": ("lettered", "n_words"),
    "common_share": ("n_common", "tokens"),
    "item_share": ("in_items", "visible"),
    "row_share": ("in_rows", "visible"),
    "code_share": ("in_codes", "visible"),
}
SCHEMA = "n_words bigint, n_lines bigint, n_common bigint, " + ", ".join(f"{r} double" for r in RATIOS) + ", junk boolean, reasons array<string>"


def text_quality(df: DataFrame, common: Iterable[str], key: str = "id", text: str = "transcription_text") -> DataFrame:
    """One row per row of ``df``: ``key``, the statistics, ``junk`` and ``reasons`` (all rules that fired, by name).

    Statistics: n_words, n_lines (with anything visible), n_common, mean_word_length, symbol_ratio (symbols per visible
    character), punctuated_share (lines ending in a sentence end), bullet_share, ellipsis_share, letter_share (words with a
    letter), common_share (of runs of letters), and the shares of visible characters in items, rows and codes. Texts are read
    whole; repeated rows keep their rows; extra columns are ignored.
    """
    known = common_hashes(common)
    kind = dict(df.dtypes)[key]
    every = RULES | CASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(list(every), dtype=object)
        for b in batches:
            c = count(b.column(1).to_pylist(), known)
            fired = np.stack([rule(c) for rule in every.values()], axis=1) if b.num_rows else np.zeros((0, len(every)), bool)
            doc, which = np.nonzero(fired)
            reasons = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(names[which], pa.string()))
            ratios = [pa.array(c[x] / np.maximum(c[y], 1), pa.float64(), mask=c[y] == 0) for x, y in RATIOS.values()]
            bad = fired[:, len(RULES) :].any(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[x]) for x in ("n_words", "n_lines", "n_common")), *ratios, pa.array(bad), reasons], names=[key, "n_words", "n_lines", "n_common", *RATIOS, "junk", "reasons"])

    return map_batches(df.select(F.col(key), spoken(F.col(text)).alias("text")), run, f"`{key}` {kind}, {SCHEMA}")


def junk_transcripts(df: DataFrame, common: Iterable[str], key: str = "id", text: str = "transcription_text") -> DataFrame:
    """Ids of rows most of whose text is list items, table rows or unreadable junk, each once."""
    return text_quality(df, common, key, text).filter("junk").select(key).distinct()
