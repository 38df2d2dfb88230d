"""Turning rows into messages and appending them to a topic log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite_key(*columns: str) -> Column:
    """Message key such as ``7-42`` from several columns."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def key_from_field(df: DataFrame, field: str) -> DataFrame:
    """Copy a value field into the message key."""
    return df.withColumn("key", F.col(field).cast("string"))


def routed(df: DataFrame, prefix: str = "", table: str | None = None, topic: str | None = None) -> DataFrame:
    """Set the topic: a fixed one, or ``prefix`` plus the content of the ``table`` column."""
    name = F.lit(topic) if topic is not None else F.concat(F.lit(prefix), F.col(table))
    return df.withColumn("topic", name)


def encode(df: DataFrame, fields: Sequence[str], key: Column | None = None) -> DataFrame:
    """Add ``key`` and the row's fields as a JSON ``value``."""
    key = F.lit(None).cast("string") if key is None else key
    return df.withColumns({"key": key, "value": F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})})


def write_topic(
    messages: DataFrame, *, path: str | None = None, brokers: str | None = None,
    compression: str = "snappy", rows_per_file: int = 5_000_000,
) -> None:
    """Append messages to a folder of parquet files, one folder per topic and partition, or to a broker.

    A busy partition is written by many tasks, ``rows_per_file`` offsets each.
    """
    if brokers is not None:
        out = messages.select("topic", "key", "value").write.format("kafka")
        out.option("kafka.bootstrap.servers", brokers).option(
            "kafka.compression.type", compression
        ).save()
        return
    cols = ["topic", "partition", "offset", "timestamp", "key", "value"]
    block = F.floor(F.col("offset") / rows_per_file)
    laid = messages.select(*cols).repartition("topic", "partition", block)
    out = laid.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("topic", "partition")
    out.option("compression", compression).parquet(path)
