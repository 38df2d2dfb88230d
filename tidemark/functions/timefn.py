"""Time columns, calendar ranges and the time macro of rotating-table queries."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern letters of the macro and their strftime forms.
MACRO_LETTERS = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}

_MACRO = re.compile(r"\{\{\s*MinAddFmt\s+(-?\d+)\s+(\w+)\s*\}\}")
_LETTERS = re.compile("|".join(MACRO_LETTERS))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def local_time(ts: Column, zone: str) -> Column:
    """The zone's wall clock at an instant, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))


def shifted_label(ts: Column, minutes: int, pattern: str, zone: str = "UTC") -> Column:
    """``ts`` moved by whole minutes, written with a date pattern in the zone's time."""
    return F.date_format(local_time(ts + F.make_interval(mins=F.lit(minutes)), zone), pattern)


def day_range(first: str, last: str) -> Column:
    """Array of all dates from ``first`` to ``last``, both included."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))


def render_macro(text: str, now: datetime) -> str:
    """Replace every ``{{ MinAddFmt <minutes> <pattern> }}`` by the shifted time."""

    def label(match: re.Match) -> str:
        moved = now + timedelta(minutes=int(match.group(1)))
        return moved.strftime(_LETTERS.sub(lambda m: MACRO_LETTERS[m.group()], match.group(2)))

    return _MACRO.sub(label, text)
