"""Pages of repeated keywords, links or product tags.

Method: line shapes. Every line, and every piece of a line between sentence ends (in runs of ``PIECE_WORDS`` words where it
is longer, as stuffing has no sentence ends), is reduced to a shape: its word count, capitals, separators and links in steps,
and how much of it are small words (those that hold sentences together), tags, and words that come again and again. The
shape alone decides whether it is a sentence shape (``non_sentence``): links or tags hold half of it; or it has links and no
small word; or no small word and words used ``MEAN_USES`` times on the page on average; or one long word fills
``STUFFED_SHARE`` of it. Pieces of a page are grouped by shape and weighed by their characters. A page is flagged if its
non-sentence shapes hold at least ``SPAM_SHARE`` of its text; the heaviest ``TOP_SHAPES`` of them are listed.

The small words are those of a given list (a fixed table), so glossaries, numbered sentences and prose with some links keep
sentence shapes. No list of host endings is used. Null, empty and blank texts are not flagged. Copies are judged like any
document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.markup import spoken
from turnwise.session import map_batches

TOP_SHAPES = 12
SPAM_SHARE = 0.5
PIECE_WORDS = 14
MEAN_USES = 2.5
STUFFED_SHARE, STUFFED_USES, STUFFED_LETTERS = 0.2, 3, 4
SCHEMA = "n_chars bigint, n_shapes bigint, spam_share double, top array<struct<shape: string, share: double>>"
_LINK = re.compile(
    r"(?:https?|hxxps?|ftp)://\S+|h ?t ?t ?p ?s? ?: ?/ ?/ ?\S+|\]\([^)\s]*\)|www\.\S+"
    r"|[\w-]+(?: ?(?:\[\.\]|\(\.\)| dot ) ?[\w-]+(?:\.[\w-]+)*)+(?:/\S*)?"
    r"|(?<![\w@.-])(?:(?-i:[a-z0-9-]{2,})\.)+(?-i:[a-z]{2,24})(?![\w@])(?:/\S*)?",
    re.I,
)
_LINKED = re.compile(r"[a-z0-9-]{2}\.[a-z]{2}|//|/ /|\[\.\]|\(\.\)|\]\(|www\.| dot ", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*")
_CUT = re.compile(r"(?<=[.!?…])\s+|\n+")
_MARK = re.compile(r"[,;:|/·•#>*»—–=+~]")


class Shape(NamedTuple):
    """A piece without its words; all fields are steps."""

    words: int  # 0 to 3, then in threes
    capitals: str  # none -, first F, some s, all A
    marks: str  # separators by kind and step
    links: int  # number, up to 3
    linked: int  # quarters of its characters in links
    tags: int  # 2 if half of it or more are tags, 1 if some
    small: int  # small words, up to 2
    uses: int  # mean uses of its words on the page: 1 from MEAN_USES on
    stuffed: int  # 1 if one long word fills it

    def __str__(self) -> str:
        return f"w{self.words} {self.capitals} {self.marks} l{self.links}/{self.linked} t{self.tags} s{self.small} u{self.uses} k{self.stuffed}"


def non_sentence(s: Shape) -> bool:
    return s.linked >= 2 or s.tags == 2 or s.links > 0 and s.small == 0 or s.small == 0 and s.uses == 1 or s.stuffed == 1


def word_step(n: int) -> int:
    return n if n < 4 else 4 + (n - 4) // 3


def outline(piece: str) -> tuple[str, str]:
    """Capitals and separators of a piece."""
    words = _WORD.findall(piece)
    caps = sum(w[0].isupper() for w in words)
    style = "-" if not caps else "A" if caps == len(words) > 1 else "F" if caps == 1 and words[0][0].isupper() else "s"
    marks = Counter(_MARK.findall(piece))
    return style, "".join(f"{m}{min(9, k.bit_length())}" for m, k in sorted(marks.items()) if k > 1 or m in "#|·")


def pieces(text: str) -> Iterator[str]:
    """Lines, cut at sentence ends; pieces of more than ``PIECE_WORDS`` words are cut into runs of so many."""
    for piece in _CUT.split(text):
        if piece and not piece.isspace():
            words = piece.split()
            if len(words) <= PIECE_WORDS:
                yield piece
            else:
                for i in range(0, len(words), PIECE_WORDS):
                    yield " ".join(words[i : i + PIECE_WORDS])


def stuffed(words: list[str], small: frozenset[str]) -> int:
    if len(words) - len(set(words)) < STUFFED_USES - 1:
        return 0
    word, n = Counter(w for w in words if len(w) >= STUFFED_LETTERS and w not in small).most_common(1)[0] if any(len(w) >= STUFFED_LETTERS and w not in small for w in words) else ("", 0)
    return int(n >= STUFFED_USES and n >= STUFFED_SHARE * len(words))


def weigh(text: str | None, small: frozenset[str]) -> tuple[int, int, float, list[tuple[str, float]]]:
    """(characters, shapes, share in all non-sentence shapes, the heaviest of them with their shares)."""
    total = 0
    found: list[tuple[str, int, list[str], int, int, int, int]] = []
    often: Counter[str] = Counter()
    weights: Counter[Shape] = Counter()
    known: dict[int, Shape] = {}
    text = text or ""
    any_link, any_tag = _LINKED.search(text), "#" in text
    for piece in pieces(text):
        size = len(piece)
        links = linked = tags = 0
        rest = piece
        if any_link and _LINKED.search(piece):
            own = _LINK.findall(piece)
            links, linked = len(own), sum(map(len, own))
            if links:
                rest = _LINK.sub(" ", piece)
        words = _WORD.findall(rest.lower())
        if not words and not links:
            continue
        total += size
        if any_tag:
            tags = piece.count("#")
        held = len([w for w in words if w in small])
        if held and not links and not tags:
            # with small words, without links and tags, capitals and separators do not matter
            n = len(words)
            key = 3 * n + min(held, 2) if n - len(set(words)) < STUFFED_USES - 1 or not stuffed(words, small) else -n
            s = known.get(key)
            if s is None:
                s = known[key] = Shape(word_step(n), "", "", 0, 0, 0, min(held, 2), 0, int(key < 0))
            weights[s] += size
            continue
        if not held:
            often.update(words)  # keywords come again and again on a stuffed page; words of a short sentence do not
        found.append((piece, size, words, links, min(4, 4 * linked // size), 2 if tags and 2 * tags >= len(words) else 1 if tags else 0, held))
    for piece, size, words, links, linked, tags, held in found:
        uses = int(not held and bool(words) and sum(often[w] for w in words) >= MEAN_USES * len(words))
        weights[Shape(word_step(len(words)), *outline(piece), min(links, 3), linked, tags, min(held, 2), uses, stuffed(words, small))] += size
    bad = Counter({s: n for s, n in weights.items() if non_sentence(s)})
    top = [(str(s), n / total) for s, n in bad.most_common(TOP_SHAPES)] if total else []
    return total, len(weights), sum(bad.values()) / total if total else 0.0, top


def line_shapes(df: DataFrame, small_words: Iterable[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_chars`` weighed, ``n_shapes``, ``spam_share`` of all non-sentence shapes and the ``top`` ones.

    Speaker labels and times around the text are not weighed. Texts are read whole; extra columns are ignored.
    """
    small = frozenset(w.lower() for w in small_words)
    kind = dict(df.dtypes)[key]
    top = pa.list_(pa.struct([("shape", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [weigh(t, small) for t in b.column(1).to_pylist()]
            chars, n, share, heavy = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chars, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array([[{"shape": s, "share": x} for s, x in h] for h in heavy], top)],
                names=[key, "n_chars", "n_shapes", "spam_share", "top"],
            )

    return map_batches(df.select(F.col(key), spoken(F.col(text)).alias("text")), run, f"`{key}` {kind}, {SCHEMA}")


def spam_pages(df: DataFrame, small_words: Iterable[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of documents most of whose text is repeated keywords, links or product tags."""
    return line_shapes(df, small_words, key, text).filter(F.col("spam_share") >= SPAM_SHARE).select(key).distinct()
