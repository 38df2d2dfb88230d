"""Tables over streams: each micro-batch stores the rows it changed, and the table is the latest row per key.

The state of the aggregation is Spark's own; a batch that is retried finds its folder written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.run import finish, write_once

BATCH = "batch"


def table_of(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """The latest row per key of the changes below ``path``."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
    values = [f.name for f in schema if f.name not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("__v"))
    return last.select(*keys, "__v.*").select(*schema.names)


def materialise(aggregated: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregation to the end of its input and return its table."""
    finish(aggregated.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_once(batch, f"{path}/{BATCH}={batch_id}")), checkpoint)
    return table_of(aggregated.sparkSession, path, keys, aggregated.schema)
