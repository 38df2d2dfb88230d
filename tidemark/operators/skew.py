"""Finding keys that hold too many rows for one task, and spreading them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import fresh_dir

# A key above this many rows is treated as hot.
HOT_ROWS = 1 << 22

# So many hot keys are handed over as a local table, whose size the planner knows; more of them are stored.
MOST_LOCAL = 100_000

# Keys are counted on a sample in which a key of ``hot_rows`` rows is expected this often.
SAMPLE_HITS = 400

COUNT = "__n"


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of ``rows`` that hold over ``hot_rows`` rows, with their estimated count ``__n``.

    None if there is no such key.  Rows are sampled and counted per key in one pass, so hardly
    anything is shuffled; a key is taken as hot from half the expected hits on, which
    makes it all but impossible to miss one.  The answer only decides how rows are
    spread, never which rows there are.  There is one row for each ``hot_rows`` rows at most, and whether it
    is broadcast is left to the planner's size check.  Null is a key like any other.
    """
    fraction = min(1.0, SAMPLE_HITS / max(hot_rows, 1))
    drawn = rows.select(*keys) if fraction == 1.0 else rows.sample(fraction, seed=17).select(*keys)
    hits = hot_rows if fraction == 1.0 else SAMPLE_HITS // 2
    counted = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hits")).where(F.col("__hits") > hits)
    found = counted.select(*keys, F.ceil(F.col("__hits") / F.lit(fraction)).cast("bigint").alias(COUNT))
    local = found.limit(MOST_LOCAL + 1).toArrow()
    if not len(local):
        return None
    if len(local) <= MOST_LOCAL:
        return rows.sparkSession.createDataFrame(local, schema=found.schema)
    path = fresh_dir(rows.sparkSession, "hot")
    found.write.parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, null equal to null; each column once."""
    names = {c: f"__r_{c}" for c in on}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def row_estimate(rows: DataFrame, unit: int) -> int:
    """About how many rows there are, good enough to cut them into parts of ``unit`` rows."""
    fraction = min(1.0, SAMPLE_HITS / max(unit, 1))
    return math.ceil((rows if fraction == 1.0 else rows.sample(fraction, seed=17)).count() / fraction)


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Sequence[str],
    how: str = "inner", hot_rows: int = HOT_ROWS, stream_salts: int = 16,
) -> DataFrame:
    """Join many rows per key with at most one ``lookup`` row per key.

    The rows of a hot key are spread over several tasks by a hash of the ``spread``
    columns, and its lookup row is copied to each of them; other keys are joined as
    they are.  Rows with a null key match nothing and are spread too.  A stream cannot be
    counted ahead, so there every key gets ``stream_salts`` copies.
    """
    salt, salts = "__salt", "__salts"
    if rows.isStreaming:
        rows = rows.withColumn(salts, F.lit(stream_salts))
        lookup = lookup.withColumn(salts, F.lit(stream_salts))
    else:
        hot = hot_keys(rows, on, hot_rows)
        if hot is None:
            return rows.join(lookup, list(on), how)
        share = F.ceil(F.col(COUNT) / F.lit(hot_rows)).cast("int")
        hot = hot.select(*on, share.alias(salts))
        rows, lookup = null_safe(rows, hot, on, "left"), null_safe(lookup, hot, on, "left")
    n = F.coalesce(F.col(salts), F.lit(1))
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), n).cast("int")).drop(salts)
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(salts)
    return left.join(right, [*on, salt], how).drop(salt)
