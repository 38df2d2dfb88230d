"""Streams in several micro-batches equal their batch forms; restarts lose and double nothing."""

import os
import pathlib
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import dedup, joins
from tidemark.session import fresh_dir
from tidemark.sinks.topic import write_topic
from tidemark.sources.files import read_json_lines
from tidemark.sources.topic import read_topic
from tidemark.streaming import late
from tidemark.streaming import operators as ops
from tidemark.streaming.asof import live_asof_join
from tidemark.streaming.busy import BusyJoin
from tidemark.streaming.changelog import materialise, table_of
from tidemark.streaming.ingest import roll_files, stream_time_partitioned
from tidemark.streaming.run import (
    Landing, append_to, file_log, in_slices, keep_state_on_disk, started, stream_files, subscribe, write_once,
)
from tidemark.streaming.run import replay as run_replay

SCHEMA = "seq bigint, key int, kind string, value bigint, ts timestamp"


def sample(spark):
    """400 events in order; key 0 holds half of them; half a minute per event."""
    n = F.col("id")
    return spark.range(400).select(
        n.alias("seq"), F.when(n % 2 == 0, 0).otherwise(n % 9).cast("int").alias("key"),
        F.when(n % 3 == 0, "b").otherwise("a").alias("kind"), F.when(n % 5 != 0, n).alias("value"),
        F.timestamp_seconds(n * 30 + 1_700_000_400).alias("ts"))


@pytest.fixture(scope="module")
def replay(spark):
    """The sample as four files in event order."""
    path = fresh_dir(spark, "replay")
    for part in range(4):
        sample(spark).where(f"seq div 100 = {part}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source orders files by their second
    return path


def stream(spark, replay):
    keep_state_on_disk(spark)
    return stream_files(spark, replay, SCHEMA, files_per_trigger=1)


def place(spark):
    root = fresh_dir(spark, "s")
    return f"{root}/out", f"{root}/checkpoint"


def test_counts(spark, replay):
    out, cp = place(spark)
    got = materialise(ops.tumbling_counts(stream(spark, replay), ["key"], "ts", "10 minutes", "1 minute", "value"),
                      ["window", "key"], out, cp)
    want = agg.tumbling_count(sample(spark), ["key"], "ts", "10 minutes", "value")
    assert rows(got.select("window.start", "key", "n")) == rows(want.select("window.start", "key", "n"))
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 4


def test_first_per_window(spark, replay):
    out, cp = place(spark)
    firsts = ops.first_per_window(stream(spark, replay), ["key", "kind"], "ts", "10 minutes", "seq", "1 minute")
    got = materialise(firsts, ["window", "key", "kind"], out, cp)
    want = dedup.dedup_windowed(sample(spark), ["key", "kind"], "ts", "10 minutes", "seq")
    assert rows(got.select("first.seq", "copies")) == rows(want, "seq", "copies")


def test_first_seen(spark, replay):
    out, cp = place(spark)
    got = append_to(ops.first_seen(stream(spark, replay), ["key", "kind"], "ts", "10 minutes", "1 minute"), out, cp)
    want = dedup.dedup_windowed(sample(spark), ["key", "kind"], "ts", "10 minutes", "seq")
    at = F.window("ts", "10 minutes").start
    assert rows(got.select(at, "key", "kind")) == rows(want.select(at, "key", "kind"))
    assert got.join(sample(spark), ["seq", "key", "kind", "ts"]).count() == got.count()


def test_within_join(spark, replay):
    def sides(df):
        a = df.where("kind = 'a'").select("key", F.col("seq").alias("x"), F.col("ts").alias("a"))
        b = df.where("kind = 'b'").select("key", F.col("seq").alias("y"), F.col("ts").alias("b"))
        return a, b

    out, cp = place(spark)
    a, b = sides(stream(spark, replay))
    c, d = sides(stream(spark, replay))
    got = append_to(ops.within_join(a, d, ["key"], "a", "b", "2 minutes", "1 minute").select("x", "y"), out, cp)
    want = joins.within_join(*sides(sample(spark)), ["key"], "a", "b", "2 minutes")
    assert want.count() > 100 and rows(got) == rows(want, "x", "y")


def parts_of(df, n=5):
    return in_slices(df, "seq", n)


def test_slices_are_consecutive_and_whole(spark):
    df = sample(spark).unionByName(sample(spark).limit(3).withColumn("seq", F.lit(None).cast("bigint")))
    for order in ("seq", "ts"):
        cut = in_slices(df, order, 5)
        assert len(cut) == 5 and sum(c.count() for c in cut) == 403
        ends = [c.agg(F.min(order), F.max(order)).first() for c in cut]
        assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert len(in_slices(df.limit(0), "seq", 3)) == 1


def odd_sample(spark):
    """The sample with some keys and table values null, and a second value column."""
    return sample(spark).withColumns({
        "key": F.when(F.col("seq") % 11 != 0, F.col("key")), "other": F.when(F.col("seq") % 4 == 1, F.concat(F.lit("x"), "seq"))})


def test_live_asof_equals_batch_over_a_restart(spark):
    keep_state_on_disk(spark)
    is_row = F.col("kind") == "b"
    out, cp = place(spark)
    df = odd_sample(spark)
    landing = Landing(spark, fresh_dir(spark, "landing"), df.schema)
    query = None
    for k, part in enumerate(parts_of(df, 6)):
        landing.arrive(part)
        if query is None:
            query = file_log(live_asof_join(landing.stream(), is_row, ["key"], "seq", ["value", "other"]), out, cp)
        query.processAllAvailable()
        if k in (1, 3):  # stopped, and started again from its checkpoint
            query.stop()
            query = None
    query.stop()
    want = joins.asof_in_log(df, is_row, ["key"], ["seq"], ["value", "other"])
    got = spark.read.parquet(out)
    assert got.columns == want.columns and rows(got) == rows(want)
    known = spark.read.format("statestore").option("stateVarName", "known").load(cp)
    assert known.count() == df.where(~is_row & F.col("key").isNotNull()).select("key").distinct().count()


def busy_sides(df):
    a = df.where("kind = 'a'").select("key", F.col("seq").alias("x"), F.col("ts").alias("a"))
    b = df.where("kind = 'b'").select("key", F.col("seq").alias("y"), F.col("ts").alias("b"))
    return a, b


@pytest.mark.parametrize("hot", [4, 1 << 20])
def test_busy_join_equals_batch_and_cuts_its_state(spark, hot):
    keep_state_on_disk(spark)
    root = fresh_dir(spark, "busy")
    df = sample(spark)
    made = []

    def start(stream):
        made.append(BusyJoin(*busy_sides(stream), ["key"], "a", "b", "10 minutes", "2 hours", root, hot))
        return made[0].start()

    run_replay(parts_of(df), start)
    want = joins.within_join(*busy_sides(df), ["key"], "a", "b", "10 minutes")
    assert want.count() > 100 and rows(made[0].pairs(), "x", "y") == rows(want, "x", "y")
    grids = made[0].grids().collect()
    if hot > 4:
        assert grids == []
        return
    assert {g.key for g in grids} >= {0} and max(g.left_n for g in grids) > 1
    placed = spark.read.parquet(f"{root}/placed").where("__bucket is not null")
    cells = placed.groupBy("side", placed.left.key, placed.right.key, "__bucket").agg(F.countDistinct("__i", "__j").alias("n"))
    assert cells.agg(F.max("n")).first()[0] > 1
    # a bucket has one grid from its first row to its last
    busy = placed.where("coalesce(left.key, right.key) = 0").groupBy("__bucket", F.coalesce("left.x", "right.y"), "side").count()
    assert busy.groupBy("__bucket", "side").agg(F.countDistinct("count").alias("n")).agg(F.max("n")).first()[0] == 1
    held = spark.read.format("statestore").option("joinSide", "left").load(f"{root}/checkpoints/join")
    one_key = held.where("key.field0 = 0").groupBy("partition_id").count()
    assert one_key.count() > 1


def test_windows_are_closed_once_and_state_stays_small(spark):
    keep_state_on_disk(spark)
    out, cp = place(spark)
    df = sample(spark).select("key", "value", "ts")

    def start(stream):
        return [file_log(ops.tumbling_counts(stream, ["key"], "ts", "10 minutes", "1 minute", "value"), out, cp)]

    query, = run_replay(in_slices(df, "ts", 8), start, ops.closing_row(df, "ts", "1 hour"))
    want = agg.tumbling_count(df, ["key"], "ts", "10 minutes", "value")
    assert rows(spark.read.parquet(out).select("window.start", "key", "n")) == rows(want.select("window.start", "key", "n"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert len({p["batchId"] for p in query.recentProgress}) >= 8 and max(held) < 0.4 * want.count()


def late_parts(spark):
    """Four arrivals; one row of the second and two of the fourth lie far behind."""
    parts = ([0, 600, 650], [1200, 10], [1300, 1250], [1900, 20, 700, None])
    return [spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn(
        "ts", F.timestamp_seconds(F.col("id") + 1_700_000_400)) for ids in parts]


def test_late_rows_have_their_own_side(spark):
    keep_state_on_disk(spark)
    root = fresh_dir(spark, "late")
    parts = late_parts(spark)
    schema = parts[0].schema

    def start(stream):
        split = late.split_late(stream, f"{root}/sides", f"{root}/cp", "ts", "1 minute")
        kept = late.kept_rows(spark, f"{root}/sides", schema, stream=True).withColumn("key", F.lit(1))
        return [split, file_log(ops.tumbling_counts(kept, ["key"], "ts", "1 minute", "1 minute"), f"{root}/out", f"{root}/cp2")]

    _, windows = run_replay(parts, start)
    behind = late.late_rows(spark, f"{root}/sides", schema)
    assert rows(behind, "id", "behind_us") == [(10, 580_000_000), (20, 1_220_000_000), (700, 540_000_000)]
    kept = late.kept_rows(spark, f"{root}/sides", schema)
    assert rows(kept, "id") == [(None,), (0,), (600,), (650,), (1200,), (1250,), (1300,), (1900,)]
    assert sum(o["numRowsDroppedByWatermark"] for p in windows.recentProgress for o in p["stateOperators"]) == 0


def test_a_split_batch_that_is_repeated_stays_as_it_was(spark):
    root = fresh_dir(spark, "late")
    split = late.LateSplit(f"{root}/sides", "ts", "1 minute")
    first, second = late_parts(spark)[:2]
    split(first, 0)
    split(second, 1)
    before = sorted(str(p) for p in pathlib.Path(f"{root}/sides").rglob("*.parquet"))
    split(second, 1)
    assert sorted(str(p) for p in pathlib.Path(f"{root}/sides").rglob("*.parquet")) == before
    assert rows(late.late_rows(spark, f"{root}/sides", first.schema), "id") == [(10,)]


def test_spark_alone_drops_and_counts_late_rows(spark):
    out, cp = place(spark)

    def start(stream):
        counts = ops.tumbling_counts(stream.withColumn("key", F.lit(1)), ["key"], "ts", "1 minute", "1 minute")
        return [started(counts.writeStream.outputMode("update").foreachBatch(
            lambda b, i: write_once(b, f"{out}/batch={i}")), cp)]

    query, = run_replay(late_parts(spark), start)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) == 3
    schema = agg.tumbling_count(late_parts(spark)[0].withColumn("key", F.lit(1)), ["key"], "ts", "1 minute").schema
    assert table_of(spark, out, ["window", "key"], schema).agg(F.sum("n")).first()[0] == 7


def test_subscriber_ends_by_count_or_time_and_goes_on(spark, replay):
    out, cp = place(spark)
    changes = stream(spark, replay).where("kind = 'b'").select("seq")
    wanted = [r.seq for r in sample(spark).where("kind = 'b'").collect()]
    got = subscribe(changes, out, cp, most=50, seconds=60, mode="append")
    assert got.count() == 50 and set(rows(got, "seq")) <= {(i,) for i in wanted}
    out, cp = place(spark)
    begin = time.monotonic()
    got = subscribe(changes, out, cp, most=10_000, seconds=12, mode="append")
    assert 12 <= time.monotonic() - begin < 40 and rows(got, "seq") == [(i,) for i in wanted]
    again = subscribe(changes, out, cp, most=10_000, seconds=2, mode="append")
    assert rows(again, "seq") == [(i,) for i in wanted]
    assert subscribe(changes, *place(spark), seconds=0).count() == 0
    with pytest.raises(ValueError):
        subscribe(changes, out, cp)


def test_first_rows_of_a_stream_over_a_restart(spark):
    keep_state_on_disk(spark)
    out, cp = place(spark)
    landing = Landing(spark, fresh_dir(spark, "landing"), sample(spark).schema)
    arrived = 0
    for part in parts_of(sample(spark), 4):
        landing.arrive(part)
        arrived += part.count()
        query = file_log(ops.first_rows(landing.stream(), 250), out, cp)
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == min(arrived, 250)
    assert spark.read.parquet(out).where("seq < 190").count() == 190


def test_files_are_closed_by_size_and_by_the_clock(spark):
    root = fresh_dir(spark, "roll")
    write_topic(messages(spark, 0, 70), path=f"{root}/topic")
    log = read_topic(spark, ["even"], path=f"{root}/topic", stream=True)
    sink = roll_files(log, f"{root}/objects", f"{root}/cp", "timestamp", "offset", "300 milliseconds", flush_size=20, unit="year")
    sink.processAllAvailable()
    write_topic(messages(spark, 70, 76), path=f"{root}/topic")
    sink.processAllAvailable()
    sink.stop()
    lines = read_json_lines(spark, f"{root}/objects", "offset bigint")
    sizes = [r["count"] for r in lines.groupBy(F.input_file_name()).count().collect()]
    assert rows(lines, "offset") == [(i,) for i in range(0, 76, 2)]
    assert max(sizes) == 20 and 3 in sizes  # a full file, and the three rows that no later ones joined in time


def messages(spark, low, high):
    return spark.range(low, high).select(
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("topic"), F.lit(0).alias("partition"),
        F.col("id").alias("offset"), F.timestamp_seconds("id").alias("timestamp"),
        F.col("id").cast("string").alias("key"), F.to_json(F.struct("id")).alias("value"))


def test_resume_and_own_start_offsets(spark):
    root = fresh_dir(spark, "s")
    write_topic(messages(spark, 0, 50), path=f"{root}/topic")

    def run(name, start="earliest"):
        log = read_topic(spark, ["even", "odd"], path=f"{root}/topic", stream=True, start=start)
        return append_to(log, f"{root}/{name}", f"{root}/cp-{name}")

    assert run("one").count() == 50
    write_topic(messages(spark, 50, 80), path=f"{root}/topic")
    assert rows(run("one"), "offset") == [(i,) for i in range(80)]
    # a derived query has its own start, whatever the first one has read
    assert rows(run("two", {"even": {0: 60}, "odd": {0: 75}}), "offset") == [
        (i,) for i in range(60, 80) if i % 2 == 0 or i >= 75]
    only = read_topic(spark, ["odd"], path=f"{root}/topic")
    assert only.count() == 40
    with pytest.raises(ValueError):
        read_topic(spark, ["odd"], path=f"{root}/topic", start="latest")


def test_sink_restart(spark):
    root = fresh_dir(spark, "s")
    for low, high in ((0, 50), (50, 120)):
        write_topic(messages(spark, low, high), path=f"{root}/topic")
        for _ in range(2):  # registered again under the same name
            log = read_topic(spark, ["even", "odd"], path=f"{root}/topic", stream=True)
            stream_time_partitioned(log, f"{root}/objects", f"{root}/cp", "timestamp", "offset", flush_size=20)
    got = read_json_lines(spark, f"{root}/objects", "offset bigint, value string")
    assert rows(got, "offset") == [(i,) for i in range(120)]


def test_resuming_opens_only_what_is_left(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_topic(messages(spark, 0, 400), path=path)
    log = read_topic(spark, path=path)
    assert log.count() == 400 and read_topic(spark, ["odd"], path=path).count() == 200
    start = {"even": {p: 300 for p in range(12)}}
    rest = read_topic(spark, ["even"], path=path, start=start)
    assert rest.count() == log.where("topic = 'even' and offset >= 300").count() > 0
    assert read_topic(spark, path=path, start=start).count() == rest.count() + 200
    plan = rest._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "topic" in scan.split("PushedFilters")[0] and "GreaterThanOrEqual(offset," in scan.split("PushedFilters")[1]
