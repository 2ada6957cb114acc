"""Diarized text into speaker segments, as expressions on the row: no shuffle, no Python.

A text is cut at separator lines into chunks; a chunk at speaker header lines into blocks; a block, after the line that
resolves its time, at lines that begin with an inline time range. What is cut is described by where cuts fall, not by a
walk over lines:

* a header's first non-blank line resolves the block: an inline range (its remainder is body), a bracket range (the whole
  line is consumed) or prose (the block is malformed and the line is body); blank lines before it are body;
* later inline ranges open further segments of the same speaker; later bracket ranges are body text;
* text before the first header is a segment without speaker, dropped if blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import bind, line_feeds, strip

SEPARATOR = r"(?m)^-{20,}[^\S\n]*$"
_SPEAKER = r"(?i)(?:\[\s*(SPEAKER_(?:\d+|[A-Z]{1,3}))\s*\]|(SPEAKER_(?:\d+|[A-Z]{1,3})))"
HEADER = rf"(?U)^[^\S\n]*{_SPEAKER}[^\S\n]*$"
_CLOCK = r"(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)"
BRACKET = rf"\[\s*{_CLOCK}\s*[-–—]\s*{_CLOCK}\s*\]"
INLINE = rf"^{_CLOCK}\s*[-–—]\s*{_CLOCK}\s*:[ ]?"
CHUNK_HEADS = r"(?m)(?=^[^\S\n]*(?:\[[^\S\n]*(?i:SPEAKER_(?:\d+|[A-Z]{1,3}))[^\S\n]*\]|(?i:SPEAKER_(?:\d+|[A-Z]{1,3})))[^\S\n]*$)"
INLINE_HEADS = r"(?m)(?=^[^\S\n]*\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\s*[-–—]\s*\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\s*:)"


def seconds(clock: Column) -> Column:
    """``h:mm:ss`` with an optional fraction, which is cut off, to whole seconds; null for text that is no clock."""
    p = F.split(F.regexp_replace(clock, r"\..*$", ""), ":")
    return F.when(F.size(p) == 3, p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")).cast("double")


def _range(line: Column, pattern: str, name: str) -> Column:
    return F.when(F.regexp_extract(line, pattern, 1) != "", seconds(F.regexp_extract(line, pattern, 1 if name == "start_s" else 2)))


def _segment(speaker: Column, body: Column, has: Column, malformed: Column, start: Column, end: Column) -> Column:
    return F.struct(
        speaker.alias("speaker"), body.alias("body"), has.alias("has_timestamp"), malformed.alias("malformed"), start.alias("start_s"), end.alias("end_s")
    )


def _closed(part: Column) -> Column:
    """Without the one line end that separates a part from what follows."""
    return F.regexp_replace(part, r"\n\z", "")


def _inline_segment(part: Column, speaker: Column) -> Column:
    first = F.regexp_extract(part, r"\A[^\S\n]*([^\n]*)", 1)

    def build(x: Column) -> Column:
        said = F.regexp_replace(x["line"], INLINE, "")
        more = F.regexp_extract(part, r"\A[^\n]*(\n?)", 1) != ""
        rest = F.regexp_replace(part, r"\A[^\n]*\n?", "")
        body = F.when(~said.rlike(r"(?U)\S"), rest).when(more, F.concat(said, F.lit("\n"), rest)).otherwise(said)
        return _segment(speaker, body, F.lit(True), F.lit(False), _range(x["line"], INLINE, "start_s"), _range(x["line"], INLINE, "end_s"))

    return bind(F.struct(strip(first).alias("line")), build)


def _resolved(x: Column) -> Column:
    """The segments of a headed block from its parts (speaker, blanks, line, broken, tail)."""
    line, bare = x["line"], x["bare"]
    inline, bracket = bare.rlike(INLINE), line.rlike(BRACKET)
    said = F.regexp_replace(bare, INLINE, "")
    kept = F.when(inline, F.when(said.rlike(r"(?U)\S"), F.concat(said, x["broken"])).otherwise(F.lit(""))).when(bracket, F.lit("")).otherwise(F.concat(line, x["broken"]))
    opening = F.concat(x["blanks"], kept, F.when(x["at_once"], F.lit("")).otherwise(x["parts"][0]))
    later = F.when(x["at_once"], x["parts"]).otherwise(F.slice(x["parts"], 2, F.size(x["parts"])))
    start = F.when(inline, _range(bare, INLINE, "start_s")).otherwise(_range(line, BRACKET, "start_s"))
    end = F.when(inline, _range(bare, INLINE, "end_s")).otherwise(_range(line, BRACKET, "end_s"))
    head = _segment(x["speaker"], _closed(opening), inline | bracket, ~inline & ~bracket & line.rlike(r"(?U)\S"), start, end)
    return F.concat(F.array(head), F.transform(F.filter(later, lambda p: p != ""), lambda p: bind(_closed(p), lambda q: _inline_segment(q, x["speaker"]))))


def _block_segments(block: Column) -> Column:
    first = F.regexp_extract(block, r"\A([^\n]*)", 1)
    named = F.regexp_extract(first, HEADER, 1), F.regexp_extract(first, HEADER, 2)
    opened = F.struct(F.upper(F.concat(*named)).alias("speaker"), F.regexp_replace(block, r"\A[^\n]*\n?", "").alias("rest"))

    def after_blanks(x: Column) -> Column:
        blanks = F.regexp_extract(x["rest"], r"(?U)\A((?:[^\S\n]*+\n)*+)", 1)
        return F.struct(x["speaker"].alias("speaker"), blanks.alias("blanks"), F.substring(x["rest"], F.length(blanks) + 1, F.length(x["rest"])).alias("after"))

    def cut(x: Column) -> Column:
        line = F.regexp_extract(x["after"], r"\A([^\n]*)", 1)
        tail = F.regexp_replace(x["after"], r"\A[^\n]*\n?", "")
        return F.struct(
            x["speaker"].alias("speaker"), x["blanks"].alias("blanks"), line.alias("line"), strip(line).alias("bare"), F.regexp_extract(x["after"], r"\A[^\n]*(\n?)", 1).alias("broken"),
            F.split(tail, INLINE_HEADS).alias("parts"), tail.rlike(r"\A" + INLINE_HEADS[4:]).alias("at_once"),
        )

    def build(x: Column) -> Column:
        return bind(bind(after_blanks(x), cut), _resolved)

    plain = _segment(F.lit(None).cast("string"), _closed(block), F.lit(False), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return bind(opened, lambda x: F.when(x["speaker"] != "", build(x)).otherwise(F.array(plain)))


def parse_segments(text: Column) -> Column:
    """Array of (speaker, body, has_timestamp, malformed, start_s, end_s) in order; empty for null and blank text."""
    chunks = F.filter(F.transform(F.split(line_feeds(text), SEPARATOR), strip), lambda c: c != "")
    blocks = F.flatten(F.transform(chunks, lambda c: F.filter(F.split(c, CHUNK_HEADS), lambda b: b != "")))
    # bind each block once: its expressions refer to it many times
    segments = F.flatten(F.transform(blocks, _block_segments))
    return F.filter(segments, lambda s: s["speaker"].isNotNull() | s["has_timestamp"] | s["body"].rlike(r"(?U)\S"))


def separator_count(text: Column) -> Column:
    return F.regexp_count(line_feeds(text), F.lit(SEPARATOR)).cast("bigint")


def bodies(segments: Column) -> Column:
    return F.transform(segments, lambda s: strip(s["body"]))


def body_text(segments: Column) -> Column:
    return F.array_join(F.filter(bodies(segments), lambda b: b != ""), "\n")
