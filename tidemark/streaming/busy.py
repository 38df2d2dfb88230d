"""Time-bounded joins of two streams in which a key may be busy.

The state of a stream-stream join lies where its join key sends it, so a key with a third of all rows
fills one state partition.  Three queries run side by side here:

* ``counts`` counts rows per key and time bucket in Spark's own state, and notes those above ``hot_rows``;
* ``place`` gives each row its bucket and its cell in the key's grid, and copies it along one direction of the grid;
* ``join`` is Spark's join on key, bucket and cell.

A grid that grows holds from the next bucket on that no row has been placed in yet, so both sides of a
bucket always use the same one, whenever their rows come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.aggregates import has_key
from tidemark.streaming.run import batch_folders, exists, file_log, read_batches, started, write_once

#: Rows of a key in a bucket that one cell of its grid may hold.
HOT_ROWS = 1 << 20
SIDES = ("left", "right")
GRID = ("__i", "__j")


class BusyJoin:
    """Inner join of rows with equal keys at most ``within`` apart; state lies below ``root``.

    Both sides need the watermark columns ``left_ts`` and ``right_ts``; other columns of the two must differ in name but for
    ``on``.  Rows without a key or a time match nothing and are left out.
    """

    def __init__(
        self, left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, within: str,
        watermark: str, root: str, hot_rows: int = HOT_ROWS,
    ):
        self.spark, self.on, self.times = left.sparkSession, list(on), (left_ts, right_ts)
        self.sides, self.within, self.watermark = (left, right), within, watermark
        self.root, self.hot_rows = root, hot_rows
        self.keys = T.StructType([left.schema[k] for k in self.on])
        bound = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {within}"))
        self.bound = int(self.spark.range(1).select(bound).first()[0])
        self.width = max(2 * self.bound, 1)

    def start(self) -> list[StreamingQuery]:
        """The three queries, upstream ones first."""
        batch_folders(self.spark, f"{self.root}/placed", self._placed_schema())
        return [self._counts(), self._place(), self._join()]

    def pairs(self) -> DataFrame:
        """What has been joined so far."""
        return self.spark.read.schema(self._joined().schema).parquet(f"{self.root}/pairs")

    def grids(self) -> DataFrame:
        """The grids in use: per key the buckets from which they hold, and their rows and columns."""
        schema = T.StructType([*self.keys.fields, *T.StructType.fromDDL("from_bucket bigint, left_n int, right_n int").fields])
        path = f"{self.root}/grids"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    # counts of each key and bucket, cumulative while the bucket is open

    def _counts(self) -> StreamingQuery:
        marked = [
            side.where(has_key([*self.on, ts])).select(*self.on, F.col(ts).alias("__ts"), F.lit(name).alias("side"))
            for name, side, ts in zip(SIDES, self.sides, self.times)]
        both = marked[0].union(marked[1]).withWatermark("__ts", self.watermark)
        counted = both.groupBy(F.window("__ts", f"{self.width} microseconds"), *self.on, "side").agg(F.count(F.lit(1)).alias("n"))

        def note(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            hot = batch.where(F.col("n") > self.hot_rows).select(*self.on, "side", "n")
            if not hot.isEmpty():
                write_once(hot, f"{self.root}/hot/batch={batch_id}")
            batch.unpersist()

        return started(counted.writeStream.outputMode("update").foreachBatch(note), f"{self.root}/checkpoints/counts")

    # buckets and cells

    def _place(self) -> StreamingQuery:
        packed = [
            side.where(has_key([*self.on, ts])).select(
                *self.on, F.lit(name).alias("side"), F.unix_micros(ts).alias("__us"), F.struct(*side.columns).alias(name))
            for name, side, ts in zip(SIDES, self.sides, self.times)]
        both = packed[0].unionByName(packed[1], allowMissingColumns=True)
        return started(both.writeStream.foreachBatch(self._place_batch), f"{self.root}/checkpoints/place")

    def _place_batch(self, batch: DataFrame, batch_id: int) -> None:
        done = f"{self.root}/marks/batch={batch_id}"
        if exists(self.spark, f"{done}/_SUCCESS"):
            return
        is_left, us = F.col("side") == "left", F.col("__us")
        reach = F.when(is_left, 0).otherwise(self.bound)
        rows = batch.withColumn("__bucket", F.explode(F.sequence(F.floor((us - reach) / self.width), F.floor((us + reach) / self.width))))
        ns = F.lit(1), F.lit(1)
        if self._adopt(batch_id):
            grids = self.grids().groupBy(*self.on).agg(
                F.sort_array(F.collect_list(F.struct("from_bucket", "left_n", "right_n"))).alias("__grids"))
            held = F.expr("filter(__grids, g -> g.from_bucket <= __bucket)")
            rows = rows.join(grids, self.on, "left").withColumn("__held", F.when(F.size(held) > 0, F.element_at(held, -1)))
            ns = F.coalesce("__held.left_n", F.lit(1)), F.coalesce("__held.right_n", F.lit(1))
        # a left row has one row of the grid and all its columns, a right row the other way round
        own = F.pmod(F.xxhash64(*[F.col(f"{name}.{c}") for name, side in zip(SIDES, self.sides) for c in side.columns]),
                     F.when(is_left, ns[0]).otherwise(ns[1])).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.when(is_left, ns[1]).otherwise(ns[0]) - 1),
            lambda k: F.struct(F.when(is_left, own).otherwise(k).alias("__i"), F.when(is_left, k).otherwise(own).alias("__j")))
        placed = rows.withColumn("__cell", F.explode(cells)).select("side", *SIDES, "__bucket", "__cell.*")
        write_once(placed, f"{self.root}/placed/batch={batch_id}")
        top = self.spark.read.parquet(f"{self.root}/placed/batch={batch_id}").agg(F.max("__bucket").alias("bucket"))
        write_once(top, done)

    def _adopt(self, batch_id: int) -> bool:
        """Larger grids for keys that were counted hot, from the first bucket on that nothing was placed in; whether there are any."""
        if not exists(self.spark, f"{self.root}/hot") or not exists(self.spark, f"{self.root}/marks"):
            return False
        top = self.spark.read.schema("bucket bigint").parquet(f"{self.root}/marks").agg(F.max("bucket")).first()[0]
        if top is None:
            return False
        schema = T.StructType([*self.keys.fields, *T.StructType.fromDDL("side string, n bigint").fields])
        parts = F.ceil(F.max("n") / self.hot_rows).cast("int")
        hot = self.spark.read.schema(schema).parquet(f"{self.root}/hot").groupBy(*self.on).pivot("side", list(SIDES)).agg(parts)
        wanted = hot.select(*self.on, *[F.coalesce(F.col(s), F.lit(1)).alias(f"{s}_n") for s in SIDES])
        have = self.grids().groupBy(*self.on).agg(F.max("left_n").alias("have_l"), F.max("right_n").alias("have_r"))
        more = (F.col("left_n") > F.coalesce("have_l", F.lit(1))) | (F.col("right_n") > F.coalesce("have_r", F.lit(1)))
        new = wanted.join(have, self.on, "left").where(more).select(
            *self.on, F.lit(top + 1).cast("bigint").alias("from_bucket"),
            F.greatest("left_n", F.coalesce("have_l", F.lit(1))).alias("left_n"),
            F.greatest("right_n", F.coalesce("have_r", F.lit(1))).alias("right_n"))
        write_once(new, f"{self.root}/grids/batch={batch_id}")
        return True

    # the join itself

    def _placed_schema(self) -> T.StructType:
        sides = [T.StructField(name, side.schema) for name, side in zip(SIDES, self.sides)]
        return T.StructType([T.StructField("side", T.StringType()), *sides,
                             *T.StructType.fromDDL("__bucket bigint, __i int, __j int").fields])

    def _joined(self) -> DataFrame:
        placed = [
            read_batches(self.spark, f"{self.root}/placed", self._placed_schema(), stream=True)
            .where(F.col("side") == name).select(f"{name}.*", "__bucket", *GRID).withWatermark(ts, self.watermark)
            for name, ts in zip(SIDES, self.times)]
        span = F.expr(f"interval {self.bound} microseconds")
        a, b = (F.col(ts) for ts in self.times)
        joined = placed[0].join(placed[1], [*self.on, "__bucket", *GRID]).where((b >= a - span) & (b <= a + span))
        return joined.drop("__bucket", *GRID)

    def _join(self) -> StreamingQuery:
        return file_log(self._joined(), f"{self.root}/pairs", f"{self.root}/checkpoints/join")
