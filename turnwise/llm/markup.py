"""What a transcript line may carry besides speech: separators, times, speaker labels and sound annotations.

The patterns are Java regular expressions for the column helpers and, where both engines agree, Python ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
# a time, a range of times or an unreadable time in brackets, at the head of a line
SPAN = rf"(?:\[?{TIME}(?: ?(?:-->|->|-|–|—) ?{TIME})?\]?:?|\[(?:no time|[-?xX\d:., ]{{4,40}})\])"
LABEL = rf"\[? {{0,2}}\p{{L}}{{2,20}}[ _](?:\d{{1,3}}|\p{{L}}) {{0,2}}\]?(?: ?\({TIME}\))?[ \t]*(?::|$)"
HEAD = rf"(?m)^[ \t]*(?:-{{20,}}[ \t]*$|(?:{SPAN}[ \t]*)?(?:{LABEL})?)"
SOUND = r"[\[(*<]\p{L}[\p{L}\p{Zs}\x{200B}]{2,30}[\])*>]"


def headless(text: Column) -> Column:
    """The text without separators, times and labels; line ends become ``\\n``. Null stays null."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), HEAD, "")


def spoken(text: Column) -> Column:
    """The text without separators, times, labels and sound annotations; line ends become ``\\n``. Null stays null."""
    return F.regexp_replace(headless(text), SOUND, " ")


PART_CHARS = 400_000


def parts(texts: list[str | None]) -> Iterator[slice]:
    """The texts of a batch in parts of at most ``PART_CHARS`` characters (or one text), so that arrays over them stay small however long texts are."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > PART_CHARS:
            yield slice(at, i)
            at, held = i, 0
        held += size
    yield slice(at, len(texts))


def fence(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: filters above it are not pushed below, where they would repeat costly expressions."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def distinct_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: repeated deliveries of a transcript count once."""
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()
