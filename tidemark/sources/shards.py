"""Rotating and date-sharded table families."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timefn import render_macro
from tidemark.operators.joins import union_all

# Fixed value: the line that separates a query from its fallback.
FALLBACK_LINE = re.compile(r"^-{5,}\s*$", re.MULTILINE)


def rotated_scan(spark: SparkSession, text: str, now: datetime, **frames: DataFrame) -> DataFrame:
    """Run a query whose table names carry a time macro.

    The part after a ``-----`` line is used when a table of the first part does not
    exist, as before the first rotation.  ``frames`` are names usable as ``{name}``.
    """
    main, *fallback = FALLBACK_LINE.split(render_macro(text, now))
    try:
        return spark.sql(main, **frames)
    except AnalysisException as e:
        if not fallback or "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
            raise
        return spark.sql(fallback[0], **frames)


def union_shards(shards: Mapping[str, DataFrame], label: str = "shard") -> DataFrame:
    """All rows of several tables of one shape, repeats included, with their shard's name."""
    return union_all([df.withColumn(label, F.lit(name)) for name, df in shards.items()])


def read_shards(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None,
    label: str = "shard_date",
) -> DataFrame:
    """A family stored as one table partitioned by shard; only the asked shards are read."""
    df = spark.read.parquet(path)
    df = df.withColumn(label, F.col(label).cast("string"))
    if first is not None:
        df = df.where(F.col(label) >= first)
    if last is not None:
        df = df.where(F.col(label) <= last)
    return df
