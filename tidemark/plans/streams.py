"""Streaming twins: each stream runs over the whole table and must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.aggregates import latest_by_offset
from tidemark.operators.audit import reconcile_counts
from tidemark.operators.joins import union_all
from tidemark.operators.skew import lookup_join
from tidemark.plans.audits import DEDUP_SQL
from tidemark.plans.common import EVENT_SCHEMA, VALUE_SQL, event_log, events, table, window_start
from tidemark.plans.joins import ASOF_SQL, LATEST_SQL
from tidemark.plans.registry import ORACLES, PARTITIONS, query
from tidemark.session import fresh_dir
from tidemark.sinks.files import time_partition_schema, write_log_lines
from tidemark.sinks.topic import write_topic
from tidemark.sources.files import read_json_lines, read_log_lines
from tidemark.sources.poll import poll_batches
from tidemark.sources.topic import TOPIC_SCHEMA, read_topic
from tidemark.streaming import ingest, late
from tidemark.streaming import operators as ops
from tidemark.streaming.asof import live_asof_join
from tidemark.streaming.busy import BusyJoin
from tidemark.streaming.run import (
    Landing, append_to, file_log, in_slices, keep_state_on_disk, replay, started, stream_files, subscribe,
)


#: Bounded micro-batches that a finished table is replayed in.
SLICES = 5


def _prepare(spark):
    """State on disk, in no more partitions than the session has cores: each one is committed with every micro-batch."""
    keep_state_on_disk(spark)
    most = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    spark.conf.set(PARTITIONS, str(most))


def event_stream(spark, sf_dir):
    _prepare(spark)
    return stream_files(spark, f"{sf_dir.rstrip('/')}/events*.parquet", EVENT_SCHEMA)


def _place(spark, name):
    root = fresh_dir(spark, name)
    return f"{root}/out", f"{root}/checkpoint"


@query("stream_tumbling_count", ORACLES["tumbling_count"])
def stream_tumbling_count(spark, sf_dir):
    """Events replayed in time order; each window comes out once, when the watermark has closed it."""
    _prepare(spark)
    out, checkpoint = _place(spark, "tumbling")
    rows = events(spark, sf_dir).select("user_id", "value", "ts")

    def start(stream):
        counts = ops.tumbling_counts(stream, ["user_id"], "ts", "1 hour", "1 hour", "value")
        return [file_log(counts.select(window_start(), "user_id", "n"), out, checkpoint)]

    replay(in_slices(rows, "ts", SLICES), start, ops.closing_row(rows, "ts", "3 hours"))
    return spark.read.parquet(out)


@query("stream_dedup_windowed", DEDUP_SQL)
def stream_dedup_windowed(spark, sf_dir):
    """Windowed dedup of replayed events; the first of each window comes out when it is closed."""
    _prepare(spark)
    out, checkpoint = _place(spark, "dedup")
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts")

    def start(stream):
        firsts = ops.first_per_window(stream, ["user_id", "event_type"], "ts", "1 hour", "event_id", "1 hour")
        return [file_log(firsts.select("first.event_id", "user_id", "event_type", "first.value", "copies"), out, checkpoint)]

    replay(in_slices(rows, "ts", SLICES), start, ops.closing_row(rows, "ts", "3 hours"))
    return spark.read.parquet(out)


@query("stream_within_join", ORACLES["within_join"])
def stream_within_join(spark, sf_dir):
    """Replayed purchases and clicks; users that turn out busy get a grid of cells from the next bucket on."""
    _prepare(spark)
    rows = events(spark, sf_dir).where("event_type in ('purchase', 'click')").select("user_id", "event_id", "event_type", "ts")
    joins = []

    def start(stream):
        purchases = stream.where("event_type = 'purchase'").select(
            "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
        clicks = stream.where("event_type = 'click'").select(
            "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
        joins.append(BusyJoin(
            purchases, clicks, ["user_id"], "bought", "clicked", "1 hour", "1 hour", fresh_dir(spark, "within")))
        return joins[0].start()

    replay(in_slices(rows, "ts", SLICES), start)
    apart = (F.unix_micros("clicked") - F.unix_micros("bought")).alias("apart_us")
    return joins[0].pairs().select("user_id", "purchase_id", "click_id", apart)


@query("stream_join_latest", LATEST_SQL)
def stream_join_latest(spark, sf_dir):
    """Streamed purchases against the table of latest clicks."""
    out, checkpoint = _place(spark, "latest")
    clicks = latest_by_offset(
        events(spark, sf_dir).where("event_type = 'click'"), ["user_id"], ["value"], "event_id")
    purchases = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("value").alias("paid"))
    joined = lookup_join(purchases, clicks, ["user_id"], ["event_id"])
    return append_to(joined.select("event_id", "user_id", "paid", "value"), out, checkpoint)


@query("stream_join_asof", ASOF_SQL)
def stream_join_asof(spark, sf_dir):
    """Replayed purchases against the clicks that arrived before them in the same stream, kept in keyed state."""
    _prepare(spark)
    out, checkpoint = _place(spark, "asof")
    log = events(spark, sf_dir).where("event_type in ('purchase', 'click')").select(
        "event_id", "user_id", "event_type", "value", F.col("value").alias("paid"))

    def start(stream):
        joined = live_asof_join(stream, F.col("event_type") == "purchase", ["user_id"], "event_id", ["value"])
        return [file_log(joined.select("event_id", "user_id", "paid", "value"), out, checkpoint)]

    replay(in_slices(log, "event_id", SLICES), start)
    return spark.read.parquet(out)


#: Every 97th event arrives 400 places late, and arrivals come in six parts of the arrival order.
ARRIVAL_SQL = """
    a as (select *, event_id + case when event_id % 97 = 0 then 400 else 0 end as arrival from events),
    arrived as (select *, (arrival - (select min(arrival) from a)) * 6 // (select max(arrival) - min(arrival) + 1 from a) as part from a)"""


def _arrivals(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    rows = rows.withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 400).otherwise(0))
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.call_function("div", (F.col("arrival") - low) * 6, F.lit(high - low + 1))
    return [rows.where(part == k) for k in range(6)]


@query("stream_late_rows", f"""
    with {ARRIVAL_SQL},
    marks as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval 1 hour as mark
              from arrived group by part)
    select event_id, case when ts < mark then 'late' else 'kept' end as side,
           case when ts < mark then epoch_us(mark) - epoch_us(ts) end as behind_us
    from arrived join marks using (part)
""")
def stream_late_rows(spark, sf_dir):
    """Rows behind the watermark go to a side output instead of being dropped: both sides together are the input."""
    root = fresh_dir(spark, "late")
    parts = _arrivals(spark, sf_dir)
    replay(parts, lambda stream: [late.split_late(stream, f"{root}/sides", f"{root}/checkpoint", "ts", "1 hour")])
    kept = late.kept_rows(spark, f"{root}/sides", parts[0].schema).withColumn("behind_us", F.lit(None).cast("bigint"))
    sides = {"kept": kept, "late": late.late_rows(spark, f"{root}/sides", parts[0].schema)}
    return union_all([df.select("event_id", F.lit(side).alias("side"), "behind_us") for side, df in sides.items()])


@query("stream_late_windows", f"""
    with {ARRIVAL_SQL},
    marks as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval 1 hour as mark
              from arrived group by part)
    select user_id, epoch_us(time_bucket(interval 1 hour, ts)) as window_start_us, count(*) as n
    from arrived join marks using (part) where mark is null or ts >= mark group by 1, 2
""")
def stream_late_windows(spark, sf_dir):
    """Windows over the kept side: the second stream's watermark, with the same delay, finds nothing more to drop."""
    _prepare(spark)
    root = fresh_dir(spark, "late")
    parts = _arrivals(spark, sf_dir)

    def start(stream):
        split = late.split_late(stream, f"{root}/sides", f"{root}/checkpoint", "ts", "1 hour")
        kept = late.kept_rows(spark, f"{root}/sides", parts[0].schema, stream=True)
        counts = ops.tumbling_counts(kept, ["user_id"], "ts", "1 hour", "1 hour")
        return [split, file_log(counts.select("user_id", window_start(), "n"), f"{root}/windows", f"{root}/second")]

    replay(parts, start, ops.closing_row(union_all(parts), "ts", "3 hours"))
    return spark.read.parquet(f"{root}/windows")


@query("derived_start", f"""
    with log as (select event_id as "offset", user_id::varchar as key, {VALUE_SQL} as value from events where event_type = 'purchase'),
    cut as (select (max("offset") + 1) // 4 as first, (max("offset") + 1) // 2 as second from log)
    select 'first' as reader, "offset", key, value from log, cut where "offset" >= first
    union all select 'second', "offset", key, value from log, cut where "offset" >= second
""")
def derived_start(spark, sf_dir):
    """A stream over a topic fills a derived topic; a stream over that one starts at offsets of its own.

    The first query has read two of three arrivals when the second starts.
    """
    root = fresh_dir(spark, "derived")
    log = event_log(spark, sf_dir, partitions=4).where("topic = 'purchase'")
    top = log.agg(F.max("offset") + 1).first()[0]
    start = {name: {"purchase": {p: top // n for p in range(4)}} for name, n in (("first", 4), ("second", 2))}
    derived = f"{root}/derived"
    first = second = None
    for k, part in enumerate(in_slices(log, "offset", 3)):
        write_topic(part, path=f"{root}/topic")
        if k == 0:
            source = read_topic(spark, path=f"{root}/topic", start=start["first"], stream=True)
            first = started(
                source.writeStream.format("parquet").option("path", derived).partitionBy("topic", "partition"), f"{root}/cp1")
        first.processAllAvailable()
        if k == 1:
            again = read_topic(spark, path=derived, start=start["second"], stream=True)
            second = file_log(again, f"{root}/out", f"{root}/cp2")
        if second is not None:
            second.processAllAvailable()
    second.stop()
    first.stop()
    read = {"first": read_topic(spark, path=derived), "second": spark.read.schema(TOPIC_SCHEMA).parquet(f"{root}/out")}
    return union_all([df.select(F.lit(name).alias("reader"), "offset", "key", "value") for name, df in read.items()])


@query("sink_roll", """
    select count(*) as messages, count(distinct event_id) as ids, true as bounded,
           count(*) >= 600 as closed_by_size, true as closed_by_clock from events where event_type = 'click'
""")
def sink_roll(spark, sf_dir):
    """Files are closed at 100 rows, or by the clock with fewer; three arrivals, each rolled before the next."""
    root = fresh_dir(spark, "roll")
    log = event_log(spark, sf_dir, partitions=1).where("topic = 'click'")
    sink = None
    for part in in_slices(log, "offset", 3):
        write_topic(part, path=f"{root}/topic")
        if sink is None:
            source = read_topic(spark, path=f"{root}/topic", stream=True)
            sink = ingest.roll_files(
                source, f"{root}/objects", f"{root}/checkpoint", "timestamp", "offset", "500 milliseconds", flush_size=100, unit="month")
        sink.processAllAvailable()
    sink.stop()
    lines = read_json_lines(spark, f"{root}/objects", TOPIC_SCHEMA, partitions=time_partition_schema("month"))
    files = lines.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    sizes = files.agg(
        F.sum("n").alias("messages"), (F.max("n") <= 100).alias("bounded"), (F.max("n") == 100).alias("closed_by_size"),
        (F.min("n") < 100).alias("closed_by_clock"))
    return sizes.crossJoin(lines.agg(F.countDistinct("offset").alias("ids"))).select(
        "messages", "ids", "bounded", "closed_by_size", "closed_by_clock")


@query("push_changes", """
    select event_type, count(*) as n, sum(user_id)::bigint as users from events group by 1
""")
def push_changes(spark, sf_dir):
    """A subscriber takes the changes of a counting query until all are there; its last ones are what a pull returns."""
    _prepare(spark)
    root = fresh_dir(spark, "push")
    rows = events(spark, sf_dir).select("event_type", "user_id", "event_id")
    landing, wanted = Landing(spark, f"{root}/landing", rows.schema), 0
    for part in in_slices(rows, "event_id", 3):
        landing.arrive(part)
        counts = landing.stream().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
        wanted += part.select("event_type").distinct().count()  # an arrival changes each type that it has once
        seen = subscribe(counts, f"{root}/changes", f"{root}/checkpoint", most=wanted, seconds=60)
    last = seen.groupBy("event_type").agg(F.max_by(F.struct("n", "users"), "batch").alias("v"))
    return last.select("event_type", "v.n", "v.users")


@query("push_rows", """
    select event_id, user_id, value from events where event_type = 'purchase'
""")
def push_rows(spark, sf_dir):
    """A subscriber that asks for as many purchases as there are ends by itself, and has got what a pull returns."""
    root = fresh_dir(spark, "push")
    rows = events(spark, sf_dir).select("event_id", "user_id", "value", "event_type")
    wanted = rows.where("event_type = 'purchase'").count()
    landing = Landing(spark, f"{root}/landing", rows.schema)
    for part in in_slices(rows, "event_id", 2):
        landing.arrive(part)
    stream = landing.stream().where("event_type = 'purchase'").select("event_id", "user_id", "value")
    return subscribe(stream, f"{root}/out", f"{root}/checkpoint", most=wanted, seconds=120, mode="append").drop("batch")


@query("stream_limit", """
    with n as (select count(*) as n from events), a as (select event_id, row_number() over (order by event_id) as r from events)
    select (r - 1) * 3 // n as part, least(count(*), greatest(any_value(n) * 5 // 6 - min(r) + 1, 0))::bigint as n_rows
    from a, n group by 1
""")
def stream_limit(spark, sf_dir):
    """The first five sixths of a stream, over three arrivals and a restart: the limit is reached inside the third one."""
    _prepare(spark)
    root = fresh_dir(spark, "limit")
    rows = events(spark, sf_dir).select("event_id")
    n = rows.count()
    parts = poll_batches(rows.withColumn("ts", F.timestamp_micros("event_id")), "ts", "event_id", 1)
    parts = parts.select("event_id", F.call_function("div", F.col("poll") * 3, F.lit(n)).cast("bigint").alias("part"))
    landing = Landing(spark, f"{root}/landing", parts.schema)
    for k in range(3):
        landing.arrive(parts.where(F.col("part") == k))
        query = file_log(ops.first_rows(landing.stream(), n * 5 // 6), f"{root}/out", f"{root}/checkpoint")
        query.processAllAvailable()
        query.stop()
    taken = spark.read.schema(parts.schema).parquet(f"{root}/out")
    return taken.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_resume", f"""
    select event_type as topic, event_id as "offset", user_id::varchar as key, {VALUE_SQL} as value from events
""")
def stream_resume(spark, sf_dir):
    """A consumer reads half a topic log, stops, and goes on from its checkpoint when more arrives."""
    root = fresh_dir(spark, "resume")
    log = event_log(spark, sf_dir, partitions=4)
    half = log.agg(F.max("offset")).first()[0] // 2
    for part in (log.where(F.col("offset") <= half), log.where(F.col("offset") > half)):
        write_topic(part, path=f"{root}/topic")
        stream = read_topic(spark, path=f"{root}/topic", stream=True)
        done = append_to(stream, f"{root}/out", f"{root}/checkpoint")
    return done.select("topic", "offset", "key", "value")


@query("sink_restart", """
    select strftime(ts + interval 9 hour, '%Y') as year, strftime(ts + interval 9 hour, '%m') as month,
           strftime(ts + interval 9 hour, '%d') as day, event_type as topic, count(*) as n,
           count(distinct event_id) as ids from events group by 1, 2, 3, 4
""")
def sink_restart(spark, sf_dir):
    """A time-partitioned sink is stopped and started again under the same checkpoint: nothing lost or doubled."""
    root = fresh_dir(spark, "restart")
    log = event_log(spark, sf_dir, partitions=4)
    half = log.agg(F.max("offset")).first()[0] // 2
    for part in (log.where(F.col("offset") <= half), log.where(F.col("offset") > half)):
        write_topic(part, path=f"{root}/topic")
        stream = read_topic(spark, path=f"{root}/topic", stream=True)
        ingest.stream_time_partitioned(
            stream, f"{root}/objects", f"{root}/checkpoint", "timestamp", "offset", unit="day")
    lines = read_json_lines(
        spark, f"{root}/objects", TOPIC_SCHEMA, partitions=time_partition_schema("day"))
    per_id = lines.groupBy("year", "month", "day", "topic", "offset").agg(F.count(F.lit(1)).alias("c"))
    return per_id.groupBy("year", "month", "day", "topic").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids"))


@query("log_ingest", f"""
    select {VALUE_SQL} as value from events
""")
def log_ingest(spark, sf_dir):
    """Log files followed as a stream: every line becomes one message."""
    root = fresh_dir(spark, "lines")
    write_log_lines(
        events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), f"{root}/logs", 100_000)
    return append_to(read_log_lines(spark, f"{root}/logs", stream=True), f"{root}/out", f"{root}/checkpoint")


@query("poll_ingest", """
    with cut as (select min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) // 3 as a,
                        min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) // 3 * 2 as b from orders)
    select o_orderkey, case when o_orderkey <= a then 1 when o_orderkey <= b then 2 else 3 end as poll
    from orders, cut
""")
def poll_ingest(spark, sf_dir):
    """A growing table polled three times into a log; each row is delivered once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    step = (high - low) // 3
    sizes = (low + step, low + 2 * step, high)
    poller = ingest.TablePoller(fresh_dir(spark, "polls"), id_col="o_orderkey")
    delivered = poller.run([lambda top=top: orders.where(F.col("o_orderkey") <= top) for top in sizes])
    return delivered.select("o_orderkey", F.col("poll").cast("int").alias("poll"))


@query("poll_several", """
    select 'orders' as source, count(*) as n, count(distinct o_orderkey) as ids, sum(o_orderkey)::bigint as total from orders
    union all select 'customers', count(*), count(distinct c_custkey), sum(c_custkey)::bigint from customer
    union all select 'events', count(*), count(distinct event_id), sum(event_id)::bigint from events
""")
def poll_several(spark, sf_dir):
    """Three growing tables polled side by side, each with its own mark; one poll fails once, and each row comes once."""
    ids = {"orders": ("orders", "o_orderkey"), "customers": ("customer", "c_custkey"), "events": ("events", "event_id")}
    pollers, sources, breaks = {}, {}, {"events"}
    for name, (source, key) in ids.items():
        rows = table(spark, sf_dir, source).select(F.col(key).alias("id"))
        pollers[name] = ingest.TablePoller(fresh_dir(spark, f"polls-{name}"), id_col="id")
        sources[name] = (rows, *rows.agg(F.min("id"), F.max("id")).first())

    def version(name, part):
        rows, low, high = sources[name]
        if part == 2 and name in breaks:
            breaks.discard(name)
            raise ConnectionError("the source is gone for a moment")
        return rows.where(F.col("id") <= low + (high - low) * part // 3)

    failed = 0
    for part in (1, 2, 3):
        done = ingest.poll_tables(pollers, {name: lambda name=name: version(name, part) for name in ids})
        failed += sum(isinstance(n, Exception) for n in done.values())
    if failed != 1:
        raise AssertionError(f"{failed} polls failed")
    return union_all([
        spark.read.parquet(f"{poller.path}/data").agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum("id").alias("total"))
        for name, poller in pollers.items()])


@query("reconcile_sink", """
    select event_type as topic, strftime(ts + interval 9 hour, '%Y%m%d') as day,
           count(*) as source_n, count(*) as sink_n, 'ok' as status from events group by 1, 2
""")
def reconcile_sink(spark, sf_dir):
    """Source rows are written to a topic, streamed to time-partitioned objects, and counted on both ends."""
    root = fresh_dir(spark, "reconcile")
    source = event_log(spark, sf_dir, partitions=4)
    write_topic(source, path=f"{root}/topic")
    stream = read_topic(spark, path=f"{root}/topic", stream=True)
    ingest.stream_time_partitioned(
        stream, f"{root}/objects", f"{root}/checkpoint", "timestamp", "offset", unit="day")
    lines = read_json_lines(spark, f"{root}/objects", TOPIC_SCHEMA, partitions=time_partition_schema("day"))
    local = F.from_utc_timestamp("timestamp", "Asia/Seoul")
    sent = source.select("topic", F.date_format(local, "yyyyMMdd").alias("day"))
    stored = lines.select("topic", F.concat("year", "month", "day").alias("day"))
    return reconcile_counts(sent, stored, ["topic", "day"])
