"""Joins of streams with streams and of streams with tables.

Stream rows may be heavily skewed towards one key, so no join here sends all
rows of a hot key to one task: lookups are salted, time-bounded joins are cut by
time, and as-of joins are cut along the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import earliest_by_offset, has_key, latest_by_offset
from tidemark.operators.running import running_last, with_running
from tidemark.operators.skew import COUNT, HOT_ROWS, hot_keys, lookup_join


def within_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, within: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of rows with equal keys whose times differ by at most ``within``.

    Time is cut into buckets of twice the bound.  Each right row is copied to the
    (two) buckets its matches can lie in, so a key is compared bucket by bucket and
    every pair is met once.  A key that is busy inside one bucket is cut into a grid: the
    rows of either side are dealt to its rows or columns by hash, and copied along the
    other direction, so no task gets more than about ``hot_rows`` of them.  Works on batches and on
    streams with watermarks; what a stream will bring cannot be counted, so there buckets stay whole.
    """
    span = F.expr(f"interval {within}")
    bound = F.unix_micros(F.timestamp_micros(F.lit(0)) + span)
    width = F.greatest(bound * 2, F.lit(1))

    def bucket(micros: Column) -> Column:
        return F.floor(micros / width)

    at = F.unix_micros(right_ts)
    cut_left = left.withColumn("__bucket", bucket(F.unix_micros(left_ts)))
    cut_right = right.withColumn(
        "__bucket", F.explode(F.sequence(bucket(at - bound), bucket(at + bound)))
    )
    near = (F.col(right_ts) >= F.col(left_ts) - span) & (F.col(right_ts) <= F.col(left_ts) + span)
    keys = [*on, "__bucket"]
    if left.isStreaming or right.isStreaming:
        return cut_left.join(cut_right, keys).where(near).drop("__bucket")
    grid = ["__i", "__j"]
    for number, side in zip(grid, (cut_left, cut_right)):
        hot = hot_keys(side, keys, hot_rows)
        if hot is not None:
            parts = hot.select(*keys, F.ceil(F.col(COUNT) / F.lit(hot_rows)).cast("int").alias(f"{number}_n"))
            cut_left, cut_right = (s.join(parts, keys, "left") for s in (cut_left, cut_right))
    if cut_left.columns == [*left.columns, "__bucket"]:
        return cut_left.join(cut_right, keys).where(near).drop("__bucket")

    def placed(side: DataFrame, own: str, columns: Sequence[str]) -> DataFrame:
        for number in grid:
            n = F.coalesce(F.col(f"{number}_n"), F.lit(1)) if f"{number}_n" in side.columns else F.lit(1)
            place = F.pmod(F.xxhash64(*columns), n).cast("int") if number == own else F.explode(F.sequence(F.lit(0), n - 1))
            side = side.withColumn(number, place)
        return side.drop(*[f"{number}_n" for number in grid])

    cut_left, cut_right = placed(cut_left, "__i", left.columns), placed(cut_right, "__j", right.columns)
    return cut_left.join(cut_right, [*keys, *grid]).where(near).drop("__bucket", *grid)


def join_latest(
    rows: DataFrame, changes: DataFrame, on: Sequence[str], values: Sequence[str], offset: str,
    spread: Sequence[str],
) -> DataFrame:
    """Inner join with the latest value per key; rows without one are dropped."""
    table = latest_by_offset(changes, on, values, offset)
    return lookup_join(rows, table, on, spread)


def asof_in_log(
    log: DataFrame, is_row: Column, on: Sequence[str], order: Sequence[str], values: Sequence[str],
    ignore_nulls: bool = True, **limits,
) -> DataFrame:
    """Left as-of join inside one log that holds both sides.

    Messages for which ``is_row`` holds are kept; each gets the values of the last
    table message of its key before it.  ``order`` must be unique within a key.
    """
    marked = log.withColumn("__row", is_row)
    is_table = ~F.col("__row") & has_key(on)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    if ignore_nulls:
        measures = {f"__v_{v}": running_last(F.when(is_table, F.col(v)), place) for v in values}
        found = {v: F.col(f"__v_{v}") for v in values}
    else:
        measures = {"__v": running_last(F.when(is_table, F.struct(*values)), place)}
        found = {v: F.col("__v").getField(v) for v in values}
    kept = [c for c in log.columns if c not in values]
    seen = with_running(marked, on, order, measures, **limits).where("__row")
    return seen.select(*kept, *[c.alias(v) for v, c in found.items()])


def asof_join(
    rows: DataFrame, changes: DataFrame, on: Sequence[str], order: Sequence[str], values: Sequence[str],
    ignore_nulls: bool = True, dense: bool = True, **limits,
) -> DataFrame:
    """Left join of each row with the table state when the row arrived.

    Both sides carry the ``order`` columns of one common order.  With an arrival
    position first, later table messages never fill earlier rows, whatever their
    event time says; with an event time first, event time decides.  A table
    message counts for a row at the same place.  ``dense`` says that the first order
    column is an arrival position.
    """
    side = "__side"
    table = changes.select(*on, *order, *values, F.lit(0).alias(side))
    log = rows.withColumn(side, F.lit(1)).unionByName(table, allowMissingColumns=True)
    joined = asof_in_log(
        log, F.col(side) == 1, on, [*order, side], values, ignore_nulls, dense=dense, **limits)
    return joined.select(*rows.columns, *values)


def fill_earliest(
    joined: DataFrame, changes: DataFrame, on: Sequence[str], values: Sequence[str], offset: str,
    spread: Sequence[str],
) -> DataFrame:
    """Fill null values of a left join with the first value ever seen for the key."""
    first = earliest_by_offset(changes, on, values, offset)
    first = first.withColumnsRenamed({v: f"__first_{v}" for v in values})
    both = lookup_join(joined, first, on, spread, "left")
    fills = {v: F.coalesce(F.col(v), F.col(f"__first_{v}")) for v in values}
    return both.withColumns(fills).select(*joined.columns)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
