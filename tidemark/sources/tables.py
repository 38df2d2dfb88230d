"""Relational scans: one table, a family of tables, or the result of a query."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TableReader = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> TableReader:
    """Reads ``<folder>/<table>.parquet``.

    Zone-less timestamps are read as UTC instants by declaring them so, not by a
    cast, which keeps time filters pushed down to the scan.
    """

    def read(table: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{table}.parquet"
        return spark.read.schema(instants(spark.read.parquet(path).schema)).parquet(path)

    return read


def instants(schema: T.StructType) -> T.StructType:
    """The schema with zone-less timestamps declared as instants."""
    return T.StructType([
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in schema
    ])


def jdbc_tables(
    spark: SparkSession,
    url: str,
    *,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    slices: int = 1,
    fetch_size: int = 1000,
    session_sql: str | None = None,
    properties: Mapping[str, str] | None = None,
) -> TableReader:
    """Reads tables over JDBC.

    ``split_on``/``bounds``/``slices`` cut the table into parallel range reads.
    ``session_sql`` runs once per connection, e.g. to choose an isolation level.
    Filters put on the result are pushed into the database's WHERE clause.
    """

    def read(table: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(**jdbc_options(
            url, split_on=split_on, bounds=bounds, slices=slices,
            fetch_size=fetch_size, session_sql=session_sql, properties=properties,
        ))
        return reader.option("dbtable", table).load()

    return read


def jdbc_query(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """Reads the result of ``sql``, which runs in the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **options)).option("query", sql).load()


def jdbc_options(
    url: str,
    *,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    slices: int = 1,
    fetch_size: int = 1000,
    session_sql: str | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if session_sql:
        options["sessionInitStatement"] = session_sql
    if split_on:
        if bounds is None:
            raise ValueError("split_on needs bounds")
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(slices),
        }
    return options


def chosen_tables(
    available: Iterable[str], only: Iterable[str] | None = None, skip: Iterable[str] = ()
) -> list[str]:
    """The named tables, or every available one that is not on the skip list."""
    if only:
        return list(only)
    banned = set(skip)
    return [t for t in available if t not in banned]


def scan_tables(read: TableReader, tables: Iterable[str], prefix: str = "") -> DataFrame:
    """All rows of several tables as messages ``topic, value``: one topic per table."""
    parts = [
        read(t).select(F.lit(prefix + t).alias("topic"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)
