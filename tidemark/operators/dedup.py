"""Windowed first-arrival dedup and log compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import has_key


def dedup_windowed(
    rows: DataFrame, keys: Sequence[str], ts: str, size: str, offset: str
) -> DataFrame:
    """The first arrival per key and tumbling window; a repeat in a later window passes again.

    Keeps the columns of ``rows`` and adds ``copies``, the rows the window held.
    """
    carried = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*carried), F.col(offset))
    kept = rows.where(has_key(keys)).groupBy(F.window(ts, size), *keys).agg(
        first.alias("__first"), F.count(F.lit(1)).alias("copies")
    )
    return kept.select(*keys, *[F.col(f"__first.{c}") for c in carried], "copies").select(
        *rows.columns, "copies"
    )


def compact_log(
    log: DataFrame,
    key: str = "key",
    offset: str = "offset",
    value: str = "value",
    closed_upto: int | None = None,
    drop_tombstones: bool = True,
) -> DataFrame:
    """The last message per key.

    A message whose whole value is null is a tombstone and removes its key.
    With ``closed_upto`` only messages below that offset are compacted; the head
    after it is kept as it is, so a key may then occur more than once.
    """
    closed = log if closed_upto is None else log.where(F.col(offset) < closed_upto)
    rest = [c for c in log.columns if c != key]
    last = closed.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(offset)).alias("__last")
    )
    tail = last.select(key, *[F.col(f"__last.{c}") for c in rest]).select(*log.columns)
    if drop_tombstones:
        tail = tail.where(F.col(value).isNotNull())
    if closed_upto is None:
        return tail
    return tail.unionByName(log.where(F.col(offset) >= closed_upto))
