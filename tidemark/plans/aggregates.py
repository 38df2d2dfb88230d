"""Windows, offset-ordered aggregates, counts, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.plans.common import events, table, window_start
from tidemark.plans.registry import query


@query("tumbling_count", """
    select epoch_us(date_trunc('hour', ts)) as window_start_us, user_id, count(value) as n
    from events where user_id is not null group by all
""")
def tumbling_count(spark, sf_dir):
    counts = agg.tumbling_count(events(spark, sf_dir), ["user_id"], "ts", "1 hour", "value")
    return counts.select(window_start(), "user_id", "n")


@query("tumbling_total", """
    select cast(sum(n) as bigint) as total, count(*) as windows, max(n) as largest from (
        select date_trunc('hour', ts), user_id, count(value) as n from events group by all)
""")
def tumbling_total(spark, sf_dir):
    counts = agg.tumbling_count(events(spark, sf_dir), ["user_id"], "ts", "1 hour", "value")
    return counts.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("windows"), F.max("n").alias("largest")
    )


@query("hopping_latest", """
    select epoch_us(date_trunc('hour', ts) - k.k * interval 1 hour) as window_start_us,
           user_id, arg_max(value, event_id) as value
    from events cross join (values (0), (1)) k(k) group by all
""")
def hopping_latest(spark, sf_dir):
    found = agg.hopping_latest(
        events(spark, sf_dir), ["user_id"], "ts", "2 hours", "1 hour", "value", "event_id"
    )
    return found.select(window_start(), "user_id", "value")


def _views_without_value(spark, sf_dir):
    value = F.when(F.col("event_type") != "view", F.col("value"))
    return events(spark, sf_dir).withColumn("value", value)


@query("latest_by_offset", """
    select user_id, arg_max(v, event_id) filter (v is not null) as value from (
        select *, case when event_type <> 'view' then value end as v from events) group by user_id
""")
def latest_by_offset(spark, sf_dir):
    return agg.latest_by_offset(_views_without_value(spark, sf_dir), ["user_id"], ["value"], "event_id")


@query("earliest_by_offset", """
    select cast(0 as bigint) as regdt, user_id, arg_min(v, event_id) filter (v is not null) as value
    from (select *, case when event_type <> 'view' then value end as v from events) group by user_id
""")
def earliest_by_offset(spark, sf_dir):
    first = agg.earliest_by_offset(_views_without_value(spark, sf_dir), ["user_id"], ["value"], "event_id")
    return first.withColumn("regdt", F.lit(0).cast("bigint"))


@query("null_key_group", """
    select key, max_by(value, event_id) as value, count(*) as n from (
        select *, case when event_type <> 'error' then user_id end as key from events)
    where key is not null group by key
""")
def null_key_group(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("key", F.when(F.col("event_type") != "error", F.col("user_id")))
    return rows.where(agg.has_key(["key"])).groupBy("key").agg(
        agg.latest("value", "event_id").alias("value"), F.count(F.lit(1)).alias("n")
    )


@query("changelog_count", """
    select event_id, user_id, count(*) over (
        partition by user_id order by event_id rows unbounded preceding) as n
    from events where user_id is not null
""")
def changelog_count(spark, sf_dir):
    return agg.changelog_count(events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id")


@query("throughput", """
    select event_type, n, seconds, n / seconds as rows_per_second from (
        select event_type, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double as seconds
        from events group by event_type)
""")
def throughput(spark, sf_dir):
    return agg.throughput(events(spark, sf_dir), ["event_type"], "ts")


@query("topk_multi", """
    select l_suppkey, l_orderkey, l_linenumber, l_partkey from lineitem
    order by l_suppkey, l_orderkey desc, l_linenumber, l_partkey limit 1000
""")
def topk_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return agg.top_rows(rows, [F.asc("l_suppkey"), F.desc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 1000)


@query("random_sample", """
    select event_id, user_id, event_type from events
    order by md5(concat('7:', event_id)), event_id limit 1000
""")
def random_sample(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return agg.sample_rows(rows, ["event_id"], 1000, seed=7)
