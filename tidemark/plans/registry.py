"""Named queries, each with the SQL text that an independent engine checks it against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import pin_utc
from tidemark.streaming.run import CHANGELOG, STATE_PROVIDER

PARTITIONS = "spark.sql.shuffle.partitions"
#: Session settings that a query may change while its plan is made.
SETTINGS = ("spark.sql.session.timeZone", STATE_PROVIDER, CHANGELOG, PARTITIONS)

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its oracle, if SQL can say it."""

    def register(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            before = {name: spark.conf.get(name, None) for name in SETTINGS}
            pin_utc(spark)
            try:
                return fn(spark, sf_dir)  # expressions have taken the zone once they are resolved
            finally:
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
