"""Streams into files, and repeated table polls into a topic log."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sinks.files import time_partitioned
from tidemark.sources.poll import Mark, next_mark, poll
from tidemark.streaming.run import finish, started


def stream_time_partitioned(
    rows: DataFrame, path: str, checkpoint: str, ts: str, offset: str, zone: str = "Asia/Seoul",
    flush_size: int = 100_000, unit: str = "minute",
) -> None:
    """Stream rows to time-partitioned gzip JSON; a restart with the same checkpoint goes on exactly once."""
    laid, fields = time_partitioned(rows, ts, offset, zone, flush_size, unit)
    writer = (
        laid.writeStream.format("json").option("path", path).option("compression", "gzip").option("ignoreNullFields", "false")
        .option("maxRecordsPerFile", flush_size).partitionBy(*fields)
    )
    finish(writer, checkpoint)


def roll_files(
    rows: DataFrame, path: str, checkpoint: str, ts: str, offset: str, rot_interval: str, zone: str = "Asia/Seoul",
    flush_size: int = 100_000, unit: str = "minute",
) -> StreamingQuery:
    """Start a time-partitioned gzip JSON sink that closes a file at ``flush_size`` rows or when ``rot_interval`` of the clock is over.

    Whatever came within an interval is written at its end, in files of at most ``flush_size`` rows, so a row waits
    no longer than the interval however few there are.  Files appear exactly once, also after a restart.
    """
    laid, fields = time_partitioned(rows, ts, offset, zone, flush_size, unit)
    writer = (
        laid.writeStream.format("json").option("path", path).option("compression", "gzip").option("ignoreNullFields", "false")
        .option("maxRecordsPerFile", flush_size).partitionBy(*fields).trigger(processingTime=rot_interval)
    )
    return started(writer, checkpoint)


class TablePoller:
    """Polls a changing table into ``<path>/data/poll=n``.

    The mark after poll n is stored once its rows are written.  A poll that failed
    in between is repeated under the same number and replaces what it left behind.
    An ``inclusive`` poll leaves out rows that earlier polls delivered, told by ``identity``.
    """

    def __init__(
        self, path: str, id_col: str | None = None, ts_col: str | None = None, identity: Sequence[str] = (), **options
    ):
        self.path, self.id_col, self.ts_col, self.identity, self.options = path, id_col, ts_col, identity, options

    def last(self, spark: SparkSession) -> tuple[int, Mark]:
        """Number of polls done, and the mark they left."""
        try:
            marks = spark.read.parquet(f"{self.path}/marks")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, Mark()
        last = marks.agg(F.max(F.struct("poll", "id", "ts_us")).alias("m")).first().m
        return (last.poll, Mark(last.id, last.ts_us)) if last else (0, Mark())

    def run_once(self, table: DataFrame) -> int:
        """One poll; returns its number."""
        spark = table.sparkSession
        done, mark = self.last(spark)
        number = done + 1
        data = f"{self.path}/data/poll={number}"
        columns = {"id_col": self.id_col, "ts_col": self.ts_col}
        before = {}
        if self.options.get("inclusive") and done:
            earlier = spark.read.schema(table.schema).parquet(*[f"{self.path}/data/poll={n}" for n in self._tied(spark, mark)])
            before = {"delivered": earlier, "identity": self.identity}
        poll(table, mark, **columns, **before, **self.options).write.mode("overwrite").parquet(data)
        after = next_mark(spark.read.parquet(data), mark, **columns)
        spark.range(1).select(
            F.lit(number).cast("bigint").alias("poll"), F.lit(after.id).cast("bigint").alias("id"),
            F.lit(after.ts_us).cast("bigint").alias("ts_us"),
        ).write.mode("overwrite").parquet(f"{self.path}/marks/n={number}")
        return number

    def _tied(self, spark: SparkSession, mark: Mark) -> list[int]:
        """The polls that may have delivered rows of the mark's time: the first that ended there, and all since."""
        ended = spark.read.parquet(f"{self.path}/marks").where(F.col("ts_us") == mark.ts_us).agg(F.min("poll")).first()[0]
        done = self.last(spark)[0]
        return list(range(ended, done + 1))

    def run_until_empty(self, table: DataFrame) -> DataFrame:
        """Poll one table until a poll delivers nothing; returns everything delivered, with its ``poll``."""
        spark = table.sparkSession
        while True:
            number = self.run_once(table)
            if spark.read.parquet(f"{self.path}/data/poll={number}").isEmpty():
                return spark.read.parquet(f"{self.path}/data")

    def run(self, versions: list[Callable[[], DataFrame]]) -> DataFrame:
        """One poll per version of the table; returns everything delivered, with its ``poll``."""
        spark = None
        for version in versions:
            table = version()
            spark = table.sparkSession
            self.run_once(table)
        return spark.read.parquet(f"{self.path}/data")


def poll_tables(
    pollers: Mapping[str, TablePoller], tables: Mapping[str, Callable[[], DataFrame]], workers: int = 8,
) -> dict[str, int | Exception]:
    """One poll of each table, side by side as parallel jobs; the number of each poll, or what it failed with.

    Every table has its own marks.  A poll that fails leaves its mark where it was and does not stop the others; the next
    call repeats it under the same number.
    """

    def one(name: str) -> int | Exception:
        try:
            return pollers[name].run_once(tables[name]())
        except Exception as failed:  # whatever a source or a job raises belongs to this table alone
            return failed

    with ThreadPoolExecutor(max_workers=min(workers, max(len(pollers), 1))) as pool:
        return dict(zip(pollers, pool.map(one, pollers)))
