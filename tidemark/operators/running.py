"""Running values over an ordered log.

A plain window over one key sorts all rows of that key in one task, which fails
when the key holds a large share of the log.  Keys are therefore counted first.
The order of a hot key is cut into segments of bounded size, and what a segment
must know about the ones before it comes from a small table of per-segment totals
that is aggregated map-side.  The result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.skew import COUNT, HOT_ROWS, hot_keys, null_safe, row_estimate
from tidemark.session import fresh_dir

SEGMENT_ROWS = 1 << 20
SEGMENT = "__segment"
# An order is stored in so many sorted ranges at most, each of which may hold many segments.
MOST_PARTS = 10_000


@dataclass(frozen=True)
class Running:
    """How one running value is computed inside a segment and carried across segments."""

    inside: Callable[[WindowSpec], Column]
    total: Column
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def running_count() -> Running:
    return Running(
        inside=lambda w: F.count(F.lit(1)).over(w),
        total=F.count(F.lit(1)),
        carry=lambda t, w: F.sum(t).over(w),
        merge=lambda before, inside: F.coalesce(before, F.lit(0)) + inside,
    )


def running_max(value: Column) -> Running:
    return Running(
        inside=lambda w: F.max(value).over(w),
        total=F.max(value),
        carry=lambda t, w: F.max(t).over(w),
        merge=lambda before, inside: F.greatest(before, inside),
    )


def running_last(value: Column, order: Column) -> Running:
    """The latest non-null ``value`` so far."""
    return Running(
        inside=lambda w: F.last(value, ignorenulls=True).over(w),
        total=F.max_by(value, F.when(value.isNotNull(), order)),
        carry=lambda t, w: F.last(t, ignorenulls=True).over(w),
        merge=lambda before, inside: F.coalesce(inside, before),
    )


def running_before(value: Column) -> Running:
    """The largest ``value`` of the rows before a row, without its own."""
    return Running(
        inside=lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        total=F.max(value),
        carry=lambda t, w: F.max(t).over(w),
        merge=lambda before, inside: F.greatest(before, inside),
    )


def stored_in_order(rows: DataFrame, order: Sequence[str], parts: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` in segments of at most ``segment_rows`` consecutive rows of ``order``, with their number as ``__segment``.

    They are sorted in ``parts`` ranges and numbered there, so a segment does not grow with the log.  They are written to
    the shared folder, since ranges are sampled and a second evaluation could cut them elsewhere.
    """
    path = fresh_dir(rows.sparkSession, "ordered")
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the numbers of a range are dense from a multiple of 2^33 on
    at = F.monotonically_increasing_id()
    number = F.shiftright(at, 33) * ((1 << 33) // segment_rows + 1) + F.floor(at.bitwiseAND((1 << 33) - 1) / segment_rows)
    ranged.withColumn(SEGMENT, number.cast("bigint")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def with_running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Running],
    dense: bool = True,
    hot_rows: int = HOT_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``rows`` plus one column per measure, running per key up to and including each row.

    ``order`` must be unique within a key.  ``dense`` says that its first column is a
    position such as an offset, unique over all rows, so that equal steps of it hold a
    bounded number of rows; otherwise hot keys are cut at sampled ranges of the order.
    Rows with a null key are a group like any other, at every size.
    """
    unbounded = Window.unboundedPreceding
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(unbounded, 0)
        return rows.select("*", *[m.inside(w).alias(n) for n, m in measures.items()])

    if dense:
        cut = rows.withColumn(SEGMENT, F.floor(F.col(order[0]) / F.lit(segment_rows)))
    else:
        total = row_estimate(rows, segment_rows) if keys else hot.first()[COUNT]
        cut = stored_in_order(rows, order, min(total // segment_rows + 1, MOST_PARTS), segment_rows)
    is_hot = "__hot"
    if keys:
        cut = null_safe(cut, hot.select(*keys, F.lit(True).alias(is_hot)), keys, "left")
        cut = cut.withColumn(SEGMENT, F.when(F.col(is_hot), F.col(SEGMENT)).otherwise(F.lit(-1)))
    else:
        cut = cut.withColumn(is_hot, F.lit(True))

    group = [*keys, SEGMENT]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(unbounded, 0)
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(unbounded, -1)
    totals = cut.where(is_hot).groupBy(*group).agg(
        *[m.total.alias(f"__t_{n}") for n, m in measures.items()])
    carried = totals.select(
        *group, *[m.carry(F.col(f"__t_{n}"), earlier).alias(f"__c_{n}") for n, m in measures.items()])
    local = cut.withColumns({f"__i_{n}": m.inside(inside) for n, m in measures.items()})
    return null_safe(local, carried, group, "left").select(
        *rows.columns,
        *[m.merge(F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n) for n, m in measures.items()],
    )
