"""Incremental table polling by id, by time, or by both.

A poll is a filter above the last mark, so it is pushed into the database or
the file scan.  Marks are plain numbers: an id, and a time in microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_count, with_running


@dataclass(frozen=True)
class Mark:
    """Where the last poll ended; None means nothing was polled yet."""

    id: int | None = None
    ts_us: int | None = None


def poll(
    table: DataFrame,
    mark: Mark,
    *,
    id_col: str | None = None,
    ts_col: str | None = None,
    now_us: int | None = None,
    delay_us: int = 0,
    inclusive: bool = False,
    batch: int | None = None,
    delivered: DataFrame | None = None,
    identity: Sequence[str] = (),
) -> DataFrame:
    """Rows a poll delivers after ``mark``.

    * ``id_col`` alone: rows with a higher id.  Updates of old rows are not seen.
    * ``ts_col`` alone: rows with a later time (or the same time if ``inclusive``;
      give what was ``delivered`` and the ``identity`` of a row, or follow with
      :func:`unseen`).  Rows tied with the mark that were not yet committed at the last
      poll are lost unless a delay covers them or the poll is inclusive.
    * both: rows after the mark in (time, id) order, so a row whose time was
      updated is delivered again.

    A poll by time delivers no row without a time, with or without ``batch``: such a row has no place before
    or behind a mark.  :func:`untimed` gives those rows apart.

    With ``now_us`` only times up to ``now_us - delay_us`` count as complete.
    ``batch`` delivers the first rows in poll order: that many where an id tells rows
    apart, and in a poll by time alone as many times as it takes to have that many rows.
    Rows of one time are never parted there, since the next poll starts behind it.
    """
    cond = _after(mark, id_col, ts_col, inclusive)
    if ts_col is not None:
        cond = cond & F.col(ts_col).isNotNull()
    if ts_col is not None and now_us is not None:
        cond = cond & (F.col(ts_col) <= _instant(now_us - delay_us))
    rows = table.where(cond)
    if delivered is not None and mark.ts_us is not None:
        rows = unseen(rows, delivered, mark, ts_col, list(identity))
    if batch is None:
        return rows
    first = rows.orderBy(*_order(id_col, ts_col)).limit(batch)
    if id_col is not None:
        return first
    last = first.agg(F.max(F.unix_micros(ts_col))).first()[0]
    return rows.limit(0) if last is None else rows.where(F.col(ts_col) <= _instant(last))


def _order(id_col: str | None, ts_col: str | None) -> list[str]:
    return [c for c in (ts_col, id_col) if c is not None]


def _instant(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


def _after(mark: Mark, id_col: str | None, ts_col: str | None, inclusive: bool) -> Column:
    if ts_col is None:
        if id_col is None:
            raise ValueError("poll by an id, a time, or both")
        return F.lit(True) if mark.id is None else F.col(id_col) > mark.id
    if mark.ts_us is None:
        return F.lit(True)
    last = _instant(mark.ts_us)
    if id_col is None:
        return F.col(ts_col) >= last if inclusive else F.col(ts_col) > last
    # the first term alone is what a scan can use to skip data
    tied = (F.col(ts_col) == last) & (F.col(id_col) > mark.id)
    return (F.col(ts_col) >= last) & ((F.col(ts_col) > last) | tied)


def untimed(table: DataFrame, ts_col: str) -> DataFrame:
    """The rows that polls by time never deliver."""
    return table.where(F.col(ts_col).isNull())


def next_mark(polled: DataFrame, mark: Mark, id_col: str | None = None, ts_col: str | None = None) -> Mark:
    """The mark after ``polled``; unchanged when it is empty."""
    if ts_col is None:
        last = polled.agg(F.max(id_col)).first()[0]
        return mark if last is None else Mark(id=last)
    at = F.unix_micros(ts_col)
    if id_col is None:
        last = polled.agg(F.max(at)).first()[0]
        return mark if last is None else Mark(ts_us=last)
    last = polled.agg(F.max(F.struct(at.alias("ts"), F.col(id_col).alias("id"))).alias("m")).first().m
    return mark if last is None else Mark(id=last.id, ts_us=last.ts)


def unseen(polled: DataFrame, delivered: DataFrame, mark: Mark, ts_col: str, identity: list[str]) -> DataFrame:
    """Rows of an inclusive poll that no earlier poll delivered.

    Only rows at the mark can be repeats, so only those are compared.
    """
    tied = delivered.where(F.col(ts_col) >= _instant(mark.ts_us))
    return polled.join(tied.select(*identity).distinct(), identity, "left_anti")


def poll_batches(table: DataFrame, ts_col: str, id_col: str, batch: int, **limits) -> DataFrame:
    """The whole table with the number of the poll that delivers each row, from 0.

    Polls run in (time, id) order and deliver ``batch`` rows each.
    """
    ranked = with_running(table, [], [ts_col, id_col], {"__n": running_count()}, dense=False, **limits)
    number = F.call_function("div", F.col("__n") - 1, F.lit(batch))
    return ranked.select(*table.columns, number.cast("bigint").alias("poll"))
