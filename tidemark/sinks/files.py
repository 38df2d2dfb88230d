"""File sinks: time-partitioned objects, log lines, table appends, date shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timefn import day_range, local_time

# Path fields of a time-partitioned object.
TIME_FIELDS = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute}


def time_fields(ts: str, zone: str, unit: str = "minute") -> dict[str, Column]:
    """The path fields down to ``unit``, in the zone's local time."""
    names = list(TIME_FIELDS)
    local = local_time(F.col(ts), zone)
    return {n: F.lpad(TIME_FIELDS[n](local).cast("string"), 4 if n == "year" else 2, "0") for n in names[: names.index(unit) + 1]}


def time_partition_schema(unit: str = "minute") -> str:
    names = list(TIME_FIELDS)
    return ", ".join(f"{n} string" for n in names[: names.index(unit) + 1])


def time_partitioned(
    df: DataFrame, ts: str, offset: str, zone: str, flush_size: int, unit: str = "minute"
) -> tuple[DataFrame, list[str]]:
    """Rows with their path fields, laid out so that one task writes whole files.

    Rows are shuffled by path and by blocks of ``flush_size`` offsets: a busy time
    is written by many tasks, and no task opens more files than it has groups.
    """
    fields = time_fields(ts, zone, unit)
    cut = df.withColumns(fields)
    block = F.floor(F.col(offset) / F.lit(flush_size))
    return cut.repartition(*fields, block), list(fields)


def write_time_partitioned(
    df: DataFrame, path: str, ts: str, offset: str, zone: str = "Asia/Seoul",
    flush_size: int = 100_000, unit: str = "minute", mode: str = "append", columns: list[str] | None = None,
) -> None:
    """Gzip JSON lines below ``year=/month=/day=/hour=/minute=``, at most ``flush_size`` per file."""
    laid, fields = time_partitioned(df, ts, offset, zone, flush_size, unit)
    kept = columns or df.columns
    (
        laid.select(*kept, *fields)
        .write.mode(mode)
        .partitionBy(*fields)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", flush_size)
        .option("ignoreNullFields", "false")
        .json(path)
    )


def write_log_lines(df: DataFrame, path: str, lines_per_file: int = 1_000_000, mode: str = "append") -> None:
    """Each row as one JSON text line; a new file starts after ``lines_per_file`` lines."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).option(
        "maxRecordsPerFile", lines_per_file
    ).text(path)


def append_table(df: DataFrame, path: str | None = None, jdbc: dict[str, str] | None = None,
                 table: str | None = None, batch: int = 1000) -> None:
    """Append rows to a table: a folder, or a database over JDBC in batches."""
    if jdbc is not None:
        df.write.format("jdbc").options(**jdbc).option("dbtable", table).option(
            "batchsize", batch
        ).mode("append").save()
    else:
        df.write.mode("append").parquet(path)


def write_shards(df: DataFrame, path: str, label: str, block: Column, mode: str = "append") -> None:
    """Write a family of shards as one table partitioned by the ``label`` column.

    ``block`` spreads a large shard over several tasks and files.
    """
    df.repartition(F.col(label), block).write.mode(mode).partitionBy(label).parquet(path)


def clone_per_day(df: DataFrame, first: str, last: str, label: str = "shard_date") -> DataFrame:
    """A full copy of the table for every date: ``label`` is the date as yyyyMMdd."""
    return df.withColumn(label, F.explode(day_range(first, last))).withColumn(
        label, F.date_format(label, "yyyyMMdd")
    )
