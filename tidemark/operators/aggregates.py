"""Windowed counts and offset-ordered aggregates.

All of these aggregate on the map side first, so a key that holds much of the
input reaches its reducer as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_count, with_running


def has_key(keys: Sequence[str]) -> Column:
    """Grouping into a table ignores rows whose key is null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def tumbling_count(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, counted: str | None = None
) -> DataFrame:
    """Rows (or non-null ``counted`` values) per key and tumbling window: ``keys, window, n``."""
    n = F.count(F.lit(1) if counted is None else F.col(counted))
    return rows.where(has_key(keys)).groupBy(F.window(ts, size), *keys).agg(n.alias("n"))


def hopping_latest(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, value: str, offset: str
) -> DataFrame:
    """Latest value by offset per key and hopping window: ``keys, window, value``."""
    return (
        rows.where(has_key(keys))
        .groupBy(F.window(ts, size, slide), *keys)
        .agg(latest(value, offset).alias(value))
    )


def latest(value: str, offset: str, ignore_nulls: bool = True) -> Column:
    """Aggregate: the value at the highest offset."""
    return F.max_by(value, _place(value, offset, ignore_nulls))


def earliest(value: str, offset: str, ignore_nulls: bool = True) -> Column:
    """Aggregate: the value at the lowest offset."""
    return F.min_by(value, _place(value, offset, ignore_nulls))


def _place(value: str, offset: str, ignore_nulls: bool) -> Column:
    # max_by and min_by skip rows whose ordering is null
    return F.when(F.col(value).isNotNull(), F.col(offset)) if ignore_nulls else F.col(offset)


def latest_by_offset(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], offset: str, ignore_nulls: bool = True
) -> DataFrame:
    """One row per key with the latest value of each column: a table over a stream."""
    return rows.where(has_key(keys)).groupBy(*keys).agg(
        *[latest(v, offset, ignore_nulls).alias(v) for v in values]
    )


def earliest_by_offset(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], offset: str, ignore_nulls: bool = True
) -> DataFrame:
    """One row per key with the first value of each column."""
    return rows.where(has_key(keys)).groupBy(*keys).agg(
        *[earliest(v, offset, ignore_nulls).alias(v) for v in values]
    )


def changelog_count(rows: DataFrame, keys: Sequence[str], offset: str, **limits) -> DataFrame:
    """Every update of a per-key count, one row per input row: column ``n``."""
    return with_running(rows.where(has_key(keys)), keys, [offset], {"n": running_count()}, **limits)


def throughput(rows: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Rows per second between the first and the last row: ``n, seconds, rows_per_second``."""
    spans = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / F.lit(1e6)).alias("seconds"),
    )
    rate = F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds"))
    return spans.withColumn("rows_per_second", rate)


def top_rows(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order: each task keeps ``n``, the driver merges them."""
    return rows.orderBy(*order).limit(n)


def sample_rows(rows: DataFrame, identity: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random; the draw depends only on the seed and the row's identity."""
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    return rows.orderBy(ticket, *identity).limit(n)
