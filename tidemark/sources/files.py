"""File scans: log lines, validated JSON lines, values taken from the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def read_log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Every line of the files as one raw message: column ``value``."""
    return (spark.readStream if stream else spark.read).text(path)


def read_json_lines(
    spark: SparkSession, path: str, schema: str, pattern: str = "*.gz", partitions: str | None = None
) -> DataFrame:
    """JSON lines of all matching files below ``path``.

    Empty lines are skipped.  A line that is not valid JSON is kept in the column
    ``_corrupt``.  ``partitions`` declares the columns stored in the path, e.g.
    ``"year string, month string"``; without it the path is not interpreted.
    """
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", pattern)
    declared = f"{schema}, {CORRUPT} string"
    if partitions is None:
        return reader.option("recursiveFileLookup", True).schema(declared).json(path)
    return reader.schema(f"{declared}, {partitions}").json(path)


def count_valid(lines: DataFrame) -> DataFrame:
    """One row: ``valid`` and ``invalid`` lines."""
    good = F.col(CORRUPT).isNull()
    # the scan only finds corrupt lines if it has to parse a declared column too
    row = F.struct(*[c for c in lines.columns if c != CORRUPT])
    return lines.agg(F.count(F.when(good, row)).alias("valid"), F.count(F.when(~good, 1)).alias("invalid"))


def path_value(pattern: str, group: int = 1) -> Column:
    """A value taken from the path of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)
