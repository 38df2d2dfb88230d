"""Streaming forms of windowed counts, dedup and joins.

The watermark is an explicit parameter; rows that come later than it are dropped
and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import dedup, joins


def tumbling_counts(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, watermark: str, counted: str | None = None
) -> DataFrame:
    """Counts per key and window, for update or append mode."""
    return agg.tumbling_count(rows.withWatermark(ts, watermark), keys, ts, size, counted)


def first_per_window(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, offset: str, watermark: str
) -> DataFrame:
    """Windowed dedup that keeps the lowest offset, whatever order a micro-batch has its rows in.

    In append mode a row comes out when its window closes; in update mode at once.
    """
    carried = [c for c in rows.columns if c not in keys]
    marked = rows.withWatermark(ts, watermark).where(agg.has_key(keys))
    first = F.min_by(F.struct(*carried), F.col(offset)).alias("first")
    return marked.groupBy(F.window(ts, size), *keys).agg(first, F.count(F.lit(1)).alias("copies"))


def first_seen(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, watermark: str
) -> DataFrame:
    """Windowed dedup that passes a row as soon as it is met (append mode, one row per key and window)."""
    window_start = F.window(ts, size).start
    others = rows.withColumns({"__start": window_start, "__us": F.unix_micros(ts)}).drop(ts)
    kept = others.withWatermark("__start", watermark).where(agg.has_key(keys)).dropDuplicates(["__start", *keys])
    return kept.withColumn(ts, F.timestamp_micros("__us")).select(*rows.columns)


def within_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, within: str,
    watermark: str,
) -> DataFrame:
    """Stream-stream join of rows at most ``within`` apart; state older than that is dropped."""
    return joins.within_join(
        left.withWatermark(left_ts, watermark), right.withWatermark(right_ts, watermark),
        on, left_ts, right_ts, within)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of a stream (append mode); Spark counts them in its state, over batches and restarts."""
    return rows.limit(n)


def closing_row(rows: DataFrame, ts: str, beyond: str) -> DataFrame:
    """The newest row of a finished table, moved ``beyond`` its time: it closes all windows, and its own stays open."""
    newest = rows.agg(F.max_by(F.struct(*rows.columns), F.col(ts)).alias("r")).select("r.*")
    return newest.withColumn(ts, F.col(ts) + F.expr(f"interval {beyond}")).where(F.col(ts).isNotNull())
