"""Repeated content: inside one transcript, and lines repeated across the documents of a host.

The named method, cross-document line frequency, hashes normalised units, counts in how many places of a host each occurs,
removes units above a limit and rejects what is left depleted. It is used at two scales:

* ``repeated_shares`` and ``repetitive``: the host is one transcript, a unit is a run of four words, the limit is one place:
  what was said before in the transcript is removed, and a transcript of which less than 70 % of the words remain is
  rejected. Equal hashes are held against the words themselves, so no collision counts. A host is one row here, so no
  shuffle is needed.
* ``line_frequency``: the host is a user, a unit is a line, places are distinct transcripts. It finds boilerplate that one
  user's transcripts share; it cannot measure what a transcript says again itself, as such a passage may begin in the middle
  of a line and occur in no other transcript (README has its figures).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.markup import fence, parts, spoken
from turnwise.session import map_batches, stash

RUN = 4
REPEATED_SHARE = 0.3
CACHE_WORDS = 1_000_000
SALTS = 16
WORD = re.compile(r"[^\W_]+(?:['’ʼ-][^\W_]+)*")
SCHEMA = "id string, n_words bigint, n_repeated bigint"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_CODES: dict[str, int] = {}


def covered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its words, and how many lie in runs of ``RUN`` or more words said earlier in it (case and punctuation aside)."""
    found = [_covered(texts[part]) for part in parts(texts)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _covered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    if len(_CODES) > CACHE_WORDS:
        _CODES.clear()
    words: list[str] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = WORD.findall(t.lower())
            n[i] = len(own)
            words += own
    for w in set(words) - _CODES.keys():
        _CODES[w] = len(_CODES)
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype=np.int64, count=len(words))
    doc = np.repeat(np.arange(len(texts)), n)
    if len(codes) < RUN:
        return n, np.zeros(len(texts), dtype=np.int64)
    h = doc[: len(doc) - RUN + 1].astype(np.uint64)
    for k in range(RUN):
        h = (h ^ codes[k : len(codes) - RUN + 1 + k].astype(np.uint64)) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
    at = np.flatnonzero(doc[: len(h)] == doc[RUN - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    again = h[order][1:] == h[order][:-1]
    for k in range(RUN):
        again &= codes[order[1:] + k] == codes[order[:-1] + k]
    said = order[1:][again & (doc[order[1:]] == doc[order[:-1]])]
    steps = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(steps, said, 1)
    np.add.at(steps, said + RUN, -1)
    return n, np.bincount(doc, weights=np.cumsum(steps)[:-1] > 0, minlength=len(texts)).astype(np.int64)


def repeated_shares(df: DataFrame, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words`` spoken, ``n_repeated`` and ``repeated_share`` (null without words).

    Null and empty texts have 0 words. Labels, times, separators and sound annotations are not words. Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, again = covered(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(again)], names=["id", "n_words", "n_repeated"])

    counted = map_batches(df.select(F.col(key).cast("string").alias("id"), spoken(F.col(text)).alias("text")), run, SCHEMA)
    return counted.withColumn("repeated_share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")))


def repetitive(df: DataFrame, key: str = "id", text: str = "transcription_text", share: float = REPEATED_SHARE) -> DataFrame:
    """Ids of transcripts at least ``share`` of whose words were already said in them, each once."""
    return repeated_shares(df, key, text).filter(F.col("repeated_share") >= share).select("id").distinct()


def line_frequency(df: DataFrame, key: str = "id", host: str = "telegram_user_internal_id", text: str = "transcription_text", limit: float = 0.01, floor: int = 20, keep: float = 0.5) -> DataFrame:
    """Cross-document line frequency: (``id``, ``host``, ``n_lines``, ``n_removed``, ``rejected``), one row per transcript with lines.

    A line (lower case, words only) is removed if it occurs in more than max(``floor``, ``limit`` x the host's documents)
    distinct documents of the host; a document is rejected if less than ``keep`` of its lines remain. Counts are made
    before the shuffle per (host, line), so a host with a third of the rows spreads over all tasks; lines are held against
    the frequent ones in ``SALTS`` parts each, so a line that most documents of a heavy host hold is no hot key either.
    Null hosts form one host, the empty one; an id that stands under two hosts is two documents.
    """
    lines = F.filter(
        F.transform(F.split(F.lower(spoken(F.col(text))), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))),
        lambda x: F.length(x) > 0,
    )
    base = df.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"))
    # repeated deliveries count once; the texts are read once, as what follows reads the hashes three times
    docs = stash(fence(base.filter(F.size("lines") > 0)).groupBy("host", "id").agg(F.min("lines").alias("lines")), "lines")
    one = docs.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    sizes = docs.groupBy("host").agg(F.count("*").alias("docs"))
    often = one.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > floor).join(sizes, "host").filter(F.col("n") > limit * F.col("docs"))
    often = often.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hit"))
    every = docs.select("host", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("lines").alias("line"))
    return (
        every.join(often, ["host", "line", "salt"], "left")
        .groupBy("id", "host")
        .agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_removed"))
        .withColumn("rejected", (F.col("n_lines") - F.col("n_removed")) < keep * F.col("n_lines"))
    )


def repetition_report(df: DataFrame, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """(id, n_words, n_repeated, repeated_share, n_lines, n_removed): repetition inside each transcript beside its lines that its user's transcripts share.

    Repeated deliveries count once; the lines of an id that stands under several users are added.
    """
    shared = line_frequency(df, key, text=text).groupBy("id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_removed").alias("n_removed"))
    none = F.lit(0).cast("bigint")
    return repeated_shares(df, key, text).dropDuplicates(["id"]).join(shared, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("n_lines", "n_removed")})
