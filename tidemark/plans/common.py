"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import topic_partition
from tidemark.session import fresh_dir
from tidemark.sinks.topic import write_topic
from tidemark.sources.tables import parquet_tables

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_tables(spark, sf_dir)(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream; ``event_id`` is its offset and its arrival order."""
    return table(spark, sf_dir, "events")


def window_start(column: str = "window"):
    return F.unix_micros(F.col(f"{column}.start")).alias("window_start_us")


def event_log(spark: SparkSession, sf_dir: str, partitions: int = 12) -> DataFrame:
    """Events as a topic log: one topic per event type, keyed by user, JSON value.

    The offset is the event id, so offsets of one topic have gaps.
    """
    key = F.col("user_id").cast("string")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("topic"),
        topic_partition(key, partitions).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        key.alias("key"),
        F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"),
    )


def stored_log(spark: SparkSession, sf_dir: str, partitions: int = 12) -> str:
    """The folder of a topic log that the events were written to."""
    path = fresh_dir(spark, "topic")
    write_topic(event_log(spark, sf_dir, partitions), path=path)
    return path


VALUE_SQL = (
    "to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'value': value})::varchar"
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested log lines: a 23-character time, a blank, and a JSON object."""
    doc = F.to_json(F.struct(
        F.struct(
            F.md5(F.col("event_id").cast("string")).alias("trace"),
            F.struct(
                F.col("user_id").alias("number"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("label"),
            ).alias("visitor"),
        ).alias("meta"),
        F.struct(
            F.col("event_type").alias("verb"),
            F.array(F.struct(F.upper("event_type").alias("area"), F.col("value").alias("amount"))).alias("parts"),
        ).alias("event"),
    ))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return events(spark, sf_dir).select("event_id", "props", F.concat(stamp, F.lit(" "), doc).alias("line"))


# The record type of a line, and its flat columns.
LINE_RECORD = (
    "struct<meta:struct<trace:string,visitor:map<string,string>>,"
    "event:struct<verb:string,parts:array<map<string,string>>>>"
)
LINE_FIELDS = {"trace": "meta.trace", "visitor": "meta.visitor", "verb": "event.verb", "part": "event.parts[0]"}

STAMP_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')"
