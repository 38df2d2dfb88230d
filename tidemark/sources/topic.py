"""Topic logs: append-only messages with topic, partition, offset, time, key and value.

A topic log has the same columns whether a broker or a folder of parquet files
holds it, so operators do not see the difference.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_SCHEMA = (
    "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"
)

Offsets = Mapping[str, Mapping[int, int]]


def read_topic(
    spark: SparkSession,
    topics: Sequence[str] | None = None,
    *,
    path: str | None = None,
    brokers: str | None = None,
    start: str | Offsets = "earliest",
    stream: bool = False,
    files_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """Scan topics from a folder (``path``) or a broker (``brokers``), as a batch or a stream.

    Without ``topics`` a folder is read with all topics it has or gets.  Topics and partitions
    are folders, so those that are not asked for are not opened, and offsets are pushed to the scan.
    ``start`` is "earliest", "latest" (streams of a broker only), or the next
    offset per topic and partition.  Topics missing from that map start at 0.
    """
    reader = spark.readStream if stream else spark.read
    if brokers is not None:
        if topics is None:
            raise ValueError("name the topics of a broker")
        source = reader.format("kafka").options(**broker_options(brokers, topics, start), **options).load()
        return source.select(
            "topic", "partition", "offset", "timestamp",
            F.col("key").cast("string"), F.col("value").cast("string"),
        )
    if path is None:
        raise ValueError("give a path or brokers")
    if start == "latest":
        raise ValueError("a folder has no latest offset; give offsets instead")
    if stream and files_per_trigger:
        options["maxFilesPerTrigger"] = files_per_trigger
    log = reader.schema(TOPIC_SCHEMA).options(**options).parquet(path)
    log = log.select("topic", "partition", "offset", "timestamp", "key", "value")
    if topics is not None:
        log = log.where(F.col("topic").isin(list(topics)))
    return log if start == "earliest" else log.where(not_before(start))


def broker_options(brokers: str, topics: Sequence[str], start: str | Offsets) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topics),
        "startingOffsets": start if isinstance(start, str) else json.dumps(
            {t: {str(p): o for p, o in parts.items()} for t, parts in start.items()}
        ),
    }


def not_before(start: Offsets) -> Column:
    """Filter: the message's offset is at or after the next offset of its partition.

    One plain term per partition, and one for partitions that ``start`` does not name, which start at 0; a
    scan takes the folders to open and the least offset to read from it.
    """
    places = [(t, p, o) for t, parts in start.items() for p, o in parts.items()]
    if not places:
        return F.lit(True)
    here = [(F.col("topic") == t) & (F.col("partition") == p) for t, p, _ in places]
    terms = [h & (F.col("offset") >= o) for h, (_, _, o) in zip(here, places)]
    other = reduce(lambda a, b: a & b, [~h for h in here]) & (F.col("offset") >= 0)
    return reduce(lambda a, b: a | b, terms) | other


def next_offsets(log: DataFrame) -> dict[str, dict[int, int]]:
    """What a consumer group commits after reading ``log``: one number per partition."""
    marks: dict[str, dict[int, int]] = {}
    for r in log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next")).collect():
        marks.setdefault(r.topic, {})[r.partition] = r.next
    return marks


def message_counts(log: DataFrame) -> DataFrame:
    """Messages per topic: ``topic, n``."""
    return log.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def offset_spans(log: DataFrame) -> DataFrame:
    """Messages per topic from offsets alone; equal to the count unless the log was compacted."""
    spans = log.groupBy("topic", "partition").agg((F.max("offset") - F.min("offset") + 1).alias("span"))
    return spans.groupBy("topic").agg(F.sum("span").alias("n"))


def decode(log: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Declared columns over a JSON value; a declared field the value lacks is null."""
    kept = [c for c in log.columns if c != value]
    return log.select(*kept, F.from_json(F.col(value), schema).alias("__v")).select(*kept, "__v.*")


def insert_values(log: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """``log`` followed by literal rows; columns they do not name are null."""
    extra = log.sparkSession.createDataFrame(rows, schema)
    return log.unionByName(extra, allowMissingColumns=True)
