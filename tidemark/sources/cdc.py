"""Change capture: envelopes of row changes, flattened and applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Operation codes of a change envelope.
READ, CREATE, UPDATE, DELETE = "r", "c", "u", "d"


def snapshot(table: DataFrame) -> DataFrame:
    """One read envelope per row: ``before, after, op``."""
    return table.select(
        F.lit(None).cast(table.schema).alias("before"), F.struct("*").alias("after"), F.lit(READ).alias("op"))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Envelopes that turn one version of a table into the next; equal rows give none."""
    a = old.select(*key, F.struct(*old.columns).alias("before"))
    b = new.select(*key, F.struct(*old.columns).alias("after"))
    both = a.join(b, list(key), "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), CREATE).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)
    return both.select("before", "after", op.alias("op"))


def to_messages(envelopes: DataFrame, *also: str) -> DataFrame:
    """Envelopes as JSON message values, with further columns kept."""
    return envelopes.select(*also, F.to_json(F.struct("before", "after", "op"), {"ignoreNullFields": "false"}).alias("value"))


def flatten(messages: DataFrame, row: str, *also: str) -> DataFrame:
    """``op``, ``before`` and ``after`` of JSON envelopes; ``row`` declares the table's columns."""
    envelope = f"struct<before:struct<{row}>,after:struct<{row}>,op:string>"
    parsed = messages.select(*also, F.from_json("value", envelope).alias("__e"))
    return parsed.select(*also, "__e.op", "__e.before", "__e.after")


def apply_changes(flat: DataFrame, key: str, offset: str) -> DataFrame:
    """The table after all changes: the last change per key, without deleted keys."""
    image = F.coalesce(F.col("after"), F.col("before"))
    last = flat.withColumn("__key", image.getField(key)).groupBy("__key").agg(
        F.max_by(F.struct("op", "after"), F.col(offset)).alias("__last"))
    return last.where(F.col("__last.op") != DELETE).select("__last.after.*")
