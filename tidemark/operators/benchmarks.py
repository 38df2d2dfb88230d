"""Mean rates per benchmark type, and the union of several benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_rates(found: DataFrame, by: str) -> DataFrame:
    """Mean insert and select rate per type: ``index, ins, sels``."""
    return found.groupBy(F.col(by).alias("index")).agg(
        F.avg(F.when(F.col("kind") == "ins", F.col("rate"))).alias("ins"),
        F.avg(F.when(F.col("kind") == "sels", F.col("rate"))).alias("sels"),
    )
