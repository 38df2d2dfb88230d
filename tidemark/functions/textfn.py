"""Text helpers: rate lines and address parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a rate is written in a benchmark line, and the words that tell its kind.
RATE_PATTERN = r"(\d+) rows per seconds"
INSERT_WORD = "Insert"
SELECT_WORD = "Selector"


def rates(lines: DataFrame, line: str) -> DataFrame:
    """Lines that report a rate, with ``kind`` (ins or sels) and ``rate``."""
    text = F.col(line)
    kind = F.when(text.contains(INSERT_WORD), "ins").when(text.contains(SELECT_WORD), "sels")
    found = lines.withColumns({"kind": kind, "__rate": F.regexp_extract(text, RATE_PATTERN, 1)})
    return (
        found.where((F.col("__rate") != "") & F.col("kind").isNotNull())
        .withColumn("rate", F.col("__rate").cast("bigint"))
        .drop("__rate")
    )


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def domain_part(email: Column) -> Column:
    return F.substring_index(email, "@", -1)
