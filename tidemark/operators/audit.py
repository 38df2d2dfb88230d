"""Completeness checks: missing ids, duplicates, late rows, reconciled counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_before, running_max, with_running
from tidemark.operators.skew import lookup_join


#: A run of missing ids is expanded in pieces of so many.
PIECE = 1 << 20


def id_gaps(seen: DataFrame, id_col: str, first: int, last: int, **limits) -> DataFrame:
    """The runs of ids from ``first`` to ``last`` that do not occur: ``first_missing, last_missing, n``.

    Each id is compared with the one before it in the order of ids, so the work goes with the ids that
    are there and not with the range.
    """
    ids = seen.select(F.col(id_col).cast("bigint").alias("__id")).where(F.col("__id").between(first, last)).distinct()
    end = seen.sparkSession.range(1).select(F.lit(last + 1).cast("bigint").alias("__id"))
    before = {"__before": running_before(F.col("__id"))}
    placed = with_running(ids.union(end), [], ["__id"], before, dense=False, **limits)
    low = F.coalesce("__before", F.lit(first - 1)) + 1
    return placed.where(F.col("__id") > low).select(
        low.alias("first_missing"), (F.col("__id") - 1).alias("last_missing"), (F.col("__id") - low).alias("n"))


def missing_ids(seen: DataFrame, id_col: str, first: int, last: int, **limits) -> DataFrame:
    """Ids from ``first`` to ``last`` that do not occur.  Only gaps are expanded, a long one by several tasks."""
    gaps = id_gaps(seen, id_col, first, last, **limits)
    steps = F.sequence("first_missing", "last_missing", F.lit(PIECE).cast("bigint"))
    pieces = gaps.select("last_missing", F.explode(steps).alias("__from"))
    long = pieces.select("__from", F.least(F.col("__from") + (PIECE - 1), "last_missing").alias("__to"))
    return long.repartition("__from").select(F.explode(F.sequence("__from", "__to")).alias(id_col))


def duplicate_report(log: DataFrame, id_col: str, place: Sequence[str]) -> DataFrame:
    """Every message of an id that occurs more than once, with its place and the copies ``n``.

    One row per message rather than a list per id: an id may have any number of copies.
    """
    repeated = log.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup_join(log.select(id_col, *place), repeated, [id_col], place)


def duplicate_rate(log: DataFrame, id_col: str) -> DataFrame:
    """One row: messages, surplus messages and their percentage."""
    per_id = log.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    sums = per_id.agg(F.sum("n").alias("messages"), F.sum(F.col("n") - 1).alias("surplus"))
    percent = F.when(F.col("messages") > 0, F.col("surplus") * 100.0 / F.col("messages"))
    return sums.withColumn("percent", percent)


def reconcile_counts(source: DataFrame, sink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key on both sides and a status: ok, missing or duplicate."""
    a = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_n"))
    b = sink.groupBy(*keys).agg(F.count(F.lit(1)).alias("sink_n"))
    both = a.join(b, list(keys), "full_outer").fillna(0, ["source_n", "sink_n"])
    status = (
        F.when(F.col("source_n") == F.col("sink_n"), "ok")
        .when(F.col("source_n") > F.col("sink_n"), "missing")
        .otherwise("duplicate")
    )
    return both.withColumn("status", status)


def late_rows(log: DataFrame, ts: str, order: Sequence[str], delay: str, **limits) -> DataFrame:
    """Messages that arrive more than ``delay`` behind the newest event time so far.

    ``order`` is the arrival order, unique over the log.
    """
    timed = log.withColumn("__ts", F.unix_micros(ts))
    newest = {"__newest": running_max(F.col("__ts"))}
    seen = with_running(timed, [], order, newest, dense=False, **limits)
    behind = F.col("__newest") - F.col("__ts")
    limit = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {delay}"))
    return seen.where(behind > limit).select(*log.columns, behind.alias("behind_us"))


def wait_until_stable(
    count: Callable[[], int], equal_reads: int = 5, pause: float = 1.0, max_reads: int = 1000
) -> int:
    """Read a count until it stays the same ``equal_reads`` times in a row."""
    last, same = count(), 0
    for _ in range(max_reads):
        time.sleep(pause)
        now = count()
        same = same + 1 if now == last else 0
        last = now
        if same >= equal_reads:
            return last
    raise TimeoutError("the count did not become stable")
