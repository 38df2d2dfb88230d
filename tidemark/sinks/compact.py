"""Compaction of a stored topic log, partition by partition, behind a pointer that readers follow."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sinks.topic import write_topic
from tidemark.sources.topic import TOPIC_SCHEMA, read_topic
from tidemark.streaming.run import exists

POINTER = "topic string, partition int, upto bigint, generation string, version bigint"


class StoredLog:
    """A topic log at ``path`` whose closed messages are compacted while it is read.

    Messages are appended to ``<path>/log``.  A compaction writes the last message per key of what it rewrites to a new
    ``<path>/compacted/generation=n`` and then one pointer file, which names for each partition the generation that stands for
    its messages below ``upto``.  A reader takes the newest pointer, so it sees the log before or after a
    compaction and nothing in between.  No file is changed or removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, messages: DataFrame) -> None:
        write_topic(messages, path=f"{self.path}/log")

    def pointer(self) -> list:
        """One row for each partition that was ever compacted: as many as the topics have partitions."""
        path = f"{self.path}/pointers"
        if not exists(self.spark, path):
            return []
        rows = self.spark.read.schema(POINTER).parquet(path)
        newest = Window.partitionBy("topic", "partition").orderBy(F.desc("version"))
        return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n").collect()

    def read(self) -> DataFrame:
        """All messages: compacted ones below each partition's ``upto``, and the others as they were written."""
        return self._view(self.pointer())

    def _view(self, places: list) -> DataFrame:
        log = read_topic(self.spark, path=f"{self.path}/log")
        if not places:
            return log

        def of(p) -> Column:
            return (F.col("topic") == p.topic) & (F.col("partition") == p.partition)

        replaced = _any([of(p) & (F.col("offset") < p.upto) for p in places])
        compacted = self.spark.read.schema(f"{TOPIC_SCHEMA}, generation string").parquet(f"{self.path}/compacted")
        current = _any([of(p) & (F.col("generation") == p.generation) for p in places])
        return compacted.where(current).select(*log.columns).unionByName(log.where(~replaced))

    def compact(self, head: int, limit: float = 0.5, drop_tombstones: bool = True) -> list[tuple[str, int]]:
        """Rewrite the closed part of each partition in which more than ``limit`` of its messages are old; returns those partitions.

        The last ``head`` offsets of a partition stay as they are.  An old message is one with a later closed message of its
        key, one without a key, and with ``drop_tombstones`` one whose value is null.
        """
        places = self.pointer()
        group = ["topic", "partition"]
        view = self._view(places)
        ends = view.groupBy(*group).agg((F.max("offset") + 1 - head).alias("upto"))
        closed = view.join(ends, group).where(F.col("offset") < F.col("upto"))
        rest = [c for c in view.columns if c not in (*group, "key")]
        last = closed.where(F.col("key").isNotNull()).groupBy(*group, "key").agg(
            F.max_by(F.struct(*rest), F.col("offset")).alias("__last")).select(*group, "key", "__last.*").select(*view.columns)
        if drop_tombstones:
            last = last.where(F.col("value").isNotNull())
        counts = closed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("upto")).join(
            last.groupBy(*group).agg(F.count(F.lit(1)).alias("kept")), group, "left")
        dirty = counts.where(F.col("n") - F.coalesce("kept", F.lit(0)) > limit * F.col("n")).collect()
        if not dirty:
            return []
        version = 1 + max((p.version for p in places), default=0)
        chosen = _any([(F.col("topic") == r.topic) & (F.col("partition") == r.partition) for r in dirty])
        generation = f"g{version}-{uuid.uuid4().hex}"  # what a failed compaction left is never named
        write_topic(last.where(chosen), path=f"{self.path}/compacted/generation={generation}")
        rows = [(r.topic, r.partition, r.upto, generation, version) for r in dirty]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")
        return sorted((r.topic, r.partition) for r in dirty)


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)
