"""Starting streams from files and running them until the available input is used up."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.session import fresh_dir

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Commits write what changed, instead of uploading all state files with every micro-batch.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def stream_files(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files at ``path``.

    Without ``files_per_trigger`` all files present form one micro-batch.  Give it
    only where file order follows event time, since a watermark that has passed
    drops older rows.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB unless the session chose a provider itself."""
    if spark.conf.get(STATE_PROVIDER, None) in (None, "") or "HDFSBacked" in spark.conf.get(STATE_PROVIDER):
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
        spark.conf.set(CHANGELOG, "true")


def finish(writer: DataStreamWriter, checkpoint: str, timeout: float | None = None) -> StreamingQuery:
    """Process everything that is available now, going on from the checkpoint if there is one."""
    started = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination(timeout)
    return started


def started(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start a query that goes on as data arrives, from its checkpoint if there is one."""
    return writer.option("checkpointLocation", checkpoint).start()


def in_slices(rows: DataFrame, order: str, slices: int) -> list[DataFrame]:
    """``rows`` as consecutive ranges of ``order`` with about equally many rows each; null comes first.

    The ranges are plain filters, so the scan skips what lies outside.
    """
    timed = isinstance(rows.schema[order].dataType, (T.TimestampType, T.TimestampNTZType))
    at = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)
    marks = rows.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 100_000)).first()[0] or []
    limits = [F.timestamp_micros(F.lit(m)) if timed else F.lit(m) for m in sorted(set(marks))]
    column = F.col(order)
    lows = [F.lit(True), *[column >= x for x in limits]]
    highs = [*[column < x for x in limits], F.lit(True)]
    cuts = [rows.where(low & high) for low, high in zip(lows, highs)]
    if limits:
        cuts[0] = rows.where(column.isNull() | highs[0])
    return cuts


class Landing:
    """A folder that rows arrive in, a slice at a time, while streams read it.  Streams start after the first slice."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def stream(self) -> DataFrame:
        return stream_files(self.spark, self.path, self.schema)

    def arrive(self, part: DataFrame, *queries: StreamingQuery) -> None:
        """Add rows, and let each query, in the order in which rows flow, work off what is there."""
        part.write.mode("append").parquet(self.path)
        for q in queries:
            q.processAllAvailable()


def replay(
    parts: Sequence[DataFrame], start: Callable[[DataFrame], Sequence[StreamingQuery]], closing: DataFrame | None = None,
) -> list[StreamingQuery]:
    """Send the parts of a finished table through streams, one after the other; returns the stopped queries.

    ``start`` gets the stream and starts its queries, upstream ones first.  Each part is worked off before the next
    arrives, so watermarks follow the order of the parts (:func:`in_slices`).  ``closing`` comes last: rows whose only
    use is to move the watermark on.
    """
    spark = parts[0].sparkSession
    landing = Landing(spark, fresh_dir(spark, "landing"), parts[0].schema)
    queries: list[StreamingQuery] = []
    try:
        for k, part in enumerate([*parts, *([] if closing is None else [closing])]):
            landing.arrive(part, *queries)
            if k == 0:
                queries += start(landing.stream())
                for q in queries:
                    q.processAllAvailable()
    finally:
        for q in reversed(queries):
            q.stop()
    return queries


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def write_once(rows: DataFrame, path: str) -> None:
    """Write a folder of a micro-batch unless an earlier try of the batch finished it, so its readers see one version."""
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)


def batch_folders(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Prepare a folder for micro-batches (``batch=n`` below it), so that streams over it may start before the first one."""
    if not exists(spark, f"{path}/batch=-1"):
        spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")


def read_batches(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """The rows of all micro-batches below a folder, as a batch or as a stream of its own."""
    declared = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return (spark.readStream if stream else spark.read).schema(declared).parquet(path).drop("batch")


def subscribe(
    rows: DataFrame, path: str, checkpoint: str, most: int | None = None, seconds: float | None = None,
    mode: str = "update", every: str = "0 seconds",
) -> DataFrame:
    """A push query with an end: takes changes as they come, until there are ``most`` or ``seconds`` have passed.

    Then the query is stopped and the changes are returned, each with the ``batch`` that brought it.  Batches go to
    folders of their own, so one that is repeated after a failure is not delivered twice, and a subscriber that
    starts again with the same checkpoint goes on where it was.
    """
    if most is None and seconds is None:
        raise ValueError("say how many changes to take, or for how long")
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])

    def taken(before: int | None = None) -> DataFrame:
        if not exists(spark, path):
            return spark.createDataFrame([], schema)
        have = spark.read.schema(schema).parquet(path)
        return have if before is None else have.where(F.col("batch") < before)

    full = Event()

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # all of the batch has to run, though only a part of it may be taken
            room = None if most is None else most - taken(batch_id).count()
            write_once(batch if room is None else batch.limit(max(room, 0)), f"{path}/batch={batch_id}")
            if room is not None and spark.read.parquet(f"{path}/batch={batch_id}").count() >= room:
                full.set()
        finally:
            batch.unpersist()

    end = None if seconds is None else time.monotonic() + seconds
    query = started(rows.writeStream.outputMode(mode).foreachBatch(take).trigger(processingTime=every), checkpoint)
    try:
        while query.isActive and (end is None or time.monotonic() < end) and not full.wait(0.1):
            pass
        patience = time.monotonic() + 10  # the batch that was the last one is still to be committed
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < patience:
            time.sleep(0.05)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return taken()


def append_to(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append a stream's rows to parquet files exactly once and read them back."""
    finish(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start appending a stream's rows to parquet files exactly once."""
    return started(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
