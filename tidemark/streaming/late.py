"""A side output for the rows of a stream that come behind its watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.run import batch_folders, exists, read_batches, started, write_once

MARKS = "batch bigint, newest_us bigint"


class LateSplit:
    """Sends each micro-batch's rows to ``<path>/kept`` or ``<path>/late``; use as a ``foreachBatch`` function.

    The watermark of a batch is the newest time of all batches before it less ``delay``, the rule by which a
    stream drops rows and only counts them.  Here late rows are kept apart, with ``behind_us``, how far they
    lie behind the watermark; rows without a time are kept.  A window, join or dedup over the kept rows with the
    same delay drops nothing.  Each batch writes folders of its own, once.
    """

    def __init__(self, path: str, ts: str, delay: str):
        self.path, self.ts, self.delay = path, ts, delay

    def watermark_us(self, spark: SparkSession, batch_id: int) -> int | None:
        """The watermark that batch ``batch_id`` is judged by."""
        if not exists(spark, f"{self.path}/marks"):
            return None
        marks = spark.read.schema(MARKS).parquet(f"{self.path}/marks")
        delay = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {self.delay}"))
        return marks.where(F.col("batch") < batch_id).agg(F.max("newest_us") - delay).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{self.path}/marks/batch={batch_id}/_SUCCESS"):
            return
        at, limit = F.unix_micros(self.ts), self.watermark_us(spark, batch_id)
        late = F.lit(False) if limit is None else F.coalesce(at < limit, F.lit(False))
        batch = batch.persist()
        try:
            write_once(batch.where(~late), f"{self.path}/kept/batch={batch_id}")
            behind = F.lit(limit).cast("bigint") - at
            write_once(batch.where(late).withColumn("behind_us", behind), f"{self.path}/late/batch={batch_id}")
            write_once(batch.agg(F.max(at).alias("newest_us")), f"{self.path}/marks/batch={batch_id}")
        finally:
            batch.unpersist()


def split_late(rows: DataFrame, path: str, checkpoint: str, ts: str, delay: str) -> StreamingQuery:
    """Start splitting a stream; read the sides with :func:`kept_rows` and :func:`late_rows`, as batches or streams."""
    for side in ("kept", "late"):
        batch_folders(rows.sparkSession, f"{path}/{side}", rows.schema)
    return started(rows.writeStream.foreachBatch(LateSplit(path, ts, delay)), checkpoint)


def kept_rows(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    return read_batches(spark, f"{path}/kept", schema, stream)


def late_rows(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    behind = T.StructType([*schema.fields, T.StructField("behind_us", T.LongType())])
    return read_batches(spark, f"{path}/late", behind, stream)
