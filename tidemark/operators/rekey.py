"""Changing the key of a stream, or the number of partitions of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import topic_partition
from tidemark.operators.running import running_count, with_running


def rekey(log: DataFrame, key: Column) -> DataFrame:
    """Key a stream by another expression; operators that need the key shuffle on it themselves."""
    return log.withColumn("key", key.cast("string"))


def repartition_topic(log: DataFrame, partitions: int, **limits) -> DataFrame:
    """Move every message to the partition of its key and number it there.

    Messages of one old partition keep their relative order, and those of several are
    merged by old offset and then old partition, which is unique, so a repeated task gives
    every message the same new offset.  New offsets are dense from 0 in each partition of
    each topic.  Messages without a key are dealt out by their old offset.
    """
    dealt = F.pmod(F.col("offset"), F.lit(partitions)).cast("int")
    moved = log.withColumn("__from", F.col("partition")).withColumn(
        "partition", F.coalesce(topic_partition(F.col("key"), partitions), dealt))
    numbered = with_running(
        moved, [*_topic(log), "partition"], ["offset", "__from"], {"__n": running_count()}, **limits)
    return numbered.withColumn("offset", F.col("__n") - 1).drop("__n", "__from")


def key_positions(log: DataFrame, **limits) -> DataFrame:
    """The place of each message in the ordered list of its topic, partition and key: ``position`` from 1.

    Messages without a key are one list per partition.
    """
    return with_running(log, [*_topic(log), "partition", "key"], ["offset"], {"position": running_count()}, **limits)


def _topic(log: DataFrame) -> list[str]:
    """A log of one topic may lack the column."""
    return ["topic"] if "topic" in log.columns else []
