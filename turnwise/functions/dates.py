"""Date and time expressions. All times are naive wall times (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def parse_created_at(text: Column, trim: bool = False) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` to a naive timestamp; null, blank and malformed text give null. ``trim`` strips blanks first."""
    t = F.trim(text) if trim else text
    return F.when(t.rlike(SHAPE), t.try_cast("timestamp_ntz"))


def bucket_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def bucket_month(ts: Column) -> Column:
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def bucket_iso_week(ts: Column) -> Column:
    """ISO year and week such as ``2025-W01``; null for a null time."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")

