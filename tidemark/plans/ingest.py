"""Incremental polls, rotating and dated shards, change capture."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.plans.common import table
from tidemark.plans.registry import query
from tidemark.session import fresh_dir
from tidemark.sinks import files as sink
from tidemark.sources import cdc, shards
from tidemark.sources.poll import Mark, next_mark, poll, poll_batches, unseen
from tidemark.streaming.ingest import TablePoller

DAY_US = 86_400_000_000
CUT = "1998-06-01"  # the time of the first poll
CUT_US = 896_659_200_000_000
LATER_US = 1_009_929_600_000_000  # 2002-01-02, after every order date


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("poll_incrementing", """
    with cut as (select (min(o_orderkey) + max(o_orderkey)) // 2 as k from orders)
    select 1 as poll, o_orderkey, o_orderstatus from orders, cut where o_orderkey <= k
    union all
    select 2, o_orderkey, case when o_orderstatus = 'P' then 'MODIFIED' else o_orderstatus end
    from orders, cut where o_orderkey > k
""")
def poll_incrementing(spark, sf_dir):
    """Half the orders exist at the first poll; later all open ones are changed and the rest added.

    The second poll sees new ids only, so changes of old rows stay invisible.
    """
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    first = poll(orders.where(F.col("o_orderkey") <= (low + high) // 2), Mark(), id_col="o_orderkey")
    mark = next_mark(first, Mark(), id_col="o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "MODIFIED").otherwise(F.col("o_orderstatus"))
    second = poll(orders.withColumn("o_orderstatus", status), mark, id_col="o_orderkey")
    return first.withColumn("poll", F.lit(1)).unionByName(second.withColumn("poll", F.lit(2)))


def _committed(spark, sf_dir):
    """Orders with the time they become visible: low priority ones a day late."""
    late = F.when(F.col("o_orderpriority") == "5-LOW", F.expr("interval 1 day")).otherwise(
        F.expr("interval 0 day"))
    return _orders(spark, sf_dir).select(
        "o_orderkey", "o_orderdate", (F.col("o_orderdate") + late).alias("visible_at"))


_COMMITTED_SQL = """
    committed as (select o_orderkey, o_orderdate, o_orderdate
        + case when o_orderpriority = '5-LOW' then interval 1 day else interval 0 day end as visible_at
        from orders)
"""


def _two_polls(spark, sf_dir, delay_us=0, inclusive=False):
    rows = _committed(spark, sf_dir)
    seen = rows.where(F.col("visible_at") <= F.timestamp_micros(F.lit(CUT_US)))
    first = poll(seen, Mark(), ts_col="o_orderdate", now_us=CUT_US, delay_us=delay_us)
    mark = next_mark(first, Mark(), ts_col="o_orderdate")
    second = poll(rows, mark, ts_col="o_orderdate", now_us=LATER_US, delay_us=delay_us, inclusive=inclusive)
    if inclusive:
        second = unseen(second, first, mark, "o_orderdate", ["o_orderkey"])
    return first.withColumn("poll", F.lit(1)).unionByName(second.withColumn("poll", F.lit(2))).select(
        "poll", "o_orderkey")


@query("poll_timestamp", f"""
    with {_COMMITTED_SQL},
    one as (select * from committed where visible_at <= timestamp '{CUT}'),
    mark as (select max(o_orderdate) as t from one)
    select 1 as poll, o_orderkey from one
    union all select 2, o_orderkey from committed, mark where o_orderdate > t
""")
def poll_timestamp(spark, sf_dir):
    """Rows tied with the mark but committed after the first poll are lost."""
    return _two_polls(spark, sf_dir)


@query("poll_ts_delay", f"""
    select case when o_orderdate <= timestamp '{CUT}' - interval 1 day then 1 else 2 end as poll, o_orderkey
    from orders
""")
def poll_ts_delay(spark, sf_dir):
    """A delay of a day lets late commits finish, so every row arrives exactly once."""
    return _two_polls(spark, sf_dir, delay_us=DAY_US)


@query("poll_ts_inclusive", f"""
    with {_COMMITTED_SQL},
    one as (select * from committed where visible_at <= timestamp '{CUT}'),
    mark as (select max(o_orderdate) as t from one)
    select 1 as poll, o_orderkey from one
    union all select 2, o_orderkey from committed, mark
    where o_orderdate >= t and o_orderkey not in (select o_orderkey from one)
""")
def poll_ts_inclusive(spark, sf_dir):
    """The rows at the mark are read again and those already delivered removed."""
    return _two_polls(spark, sf_dir, inclusive=True)


@query("poll_ts_inc", f"""
    with v2 as (select o_orderkey, case when o_orderstatus = 'P' and o_orderdate <= timestamp '{CUT}'
                    then timestamp '2002-01-01' else o_orderdate end as moved,
                    case when o_orderstatus = 'P' then 'MODIFIED' else o_orderstatus end as status
                from orders),
    mark as (select max((o_orderdate, o_orderkey)) as m from orders where o_orderdate <= timestamp '{CUT}')
    select 1 as poll, o_orderkey, o_orderstatus as status from orders where o_orderdate <= timestamp '{CUT}'
    union all select 2, o_orderkey, status from v2, mark where (moved, o_orderkey) > m
""")
def poll_ts_inc(spark, sf_dir):
    """A changed row whose time moved is delivered again: both versions are in the topic."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    cut = F.timestamp_micros(F.lit(CUT_US))
    by = {"id_col": "o_orderkey", "ts_col": "o_orderdate"}
    first = poll(orders.where(F.col("o_orderdate") <= cut), Mark(), **by)
    mark = next_mark(first, Mark(), **by)
    open_ = F.col("status") == "P"
    moved = F.when(open_ & (F.col("o_orderdate") <= cut), F.timestamp_micros(F.lit(LATER_US - DAY_US)))
    changed = orders.withColumns({
        "o_orderdate": moved.otherwise(F.col("o_orderdate")),
        "status": F.when(open_, "MODIFIED").otherwise(F.col("status")),
    })
    second = poll(changed, mark, **by)
    return first.withColumn("poll", F.lit(1)).unionByName(second.withColumn("poll", F.lit(2))).select(
        "poll", "o_orderkey", "status")


_YEARLY = "select o_orderkey, poll::int as poll from (select o_orderkey, dense_rank() over (order by year(o_orderdate)) as poll from orders)"


def _yearly_polls(spark, sf_dir, **options):
    """Orders that carry only their year, so that far more are tied than a batch holds."""
    orders = _orders(spark, sf_dir).select("o_orderkey", F.date_trunc("year", "o_orderdate").alias("year"))
    poller = TablePoller(fresh_dir(spark, "polls"), ts_col="year", batch=100, **options)
    return poller.run_until_empty(orders).select("o_orderkey", "poll")


@query("poll_ts_batched", _YEARLY)
def poll_ts_batched(spark, sf_dir):
    """Batched polls by time alone until nothing is left: every order once, ties in one poll."""
    return _yearly_polls(spark, sf_dir)


@query("poll_ts_batched_inclusive", _YEARLY)
def poll_ts_batched_inclusive(spark, sf_dir):
    """The same with inclusive polls, which leave out what was delivered before the batch is cut."""
    return _yearly_polls(spark, sf_dir, inclusive=True, identity=["o_orderkey"])


@query("poll_batches", """
    select o_orderkey, (row_number() over (order by o_orderdate, o_orderkey) - 1) // 1000 as poll from orders
""")
def poll_batches_of_orders(spark, sf_dir):
    """Which poll of a thousand rows delivers each order."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return poll_batches(orders, "o_orderdate", "o_orderkey", 1000).select("o_orderkey", "poll")


@query("rotated_union", f"""
    select case when l_shipdate < timestamp '{CUT}' then 'closed' else 'current' end as shard,
           l_orderkey, l_linenumber, l_partkey from lineitem
""")
def rotated_union(spark, sf_dir):
    """Line items rotated once, read back through the macro query."""
    lines = table(spark, sf_dir, "lineitem")
    cut = F.timestamp_micros(F.lit(CUT_US))
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    name = f"lines_{uuid.uuid4().hex}"
    now = datetime(1998, 6, 1, 0, 1)  # one minute after the rotation
    lines.where(F.col("l_shipdate") < cut).select(*cols).createOrReplaceTempView(f"{name}_010000")
    lines.where(F.col("l_shipdate") >= cut).select(*cols).createOrReplaceTempView(name)
    rotated = shards.rotated_scan(spark, f"""
        SELECT * FROM (
            SELECT 'closed' AS shard, * FROM {name}_{{{{ MinAddFmt -1 ddHHmm }}}}
            UNION ALL
            SELECT 'current' AS shard, * FROM {name}
        ) AS t
        -----
        SELECT 'current' AS shard, * FROM {name}
        """.replace("        -----", "-----"), now)
    for view in (f"{name}_010000", name):
        spark.catalog.dropTempView(view)  # the plan is resolved
    return rotated


@query("date_sharded_union", """
    select strftime(o_orderdate, '%Y%m') as shard_date, o_orderkey, o_totalprice from orders
""")
def date_sharded_union(spark, sf_dir):
    """Orders stored as one table per month, all months read together."""
    path = fresh_dir(spark, "shards")
    orders = _orders(spark, sf_dir).select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyyMM").alias("shard_date"))
    sink.write_shards(orders, path, "shard_date", F.floor(F.col("o_orderkey") / F.lit(1 << 20)))
    return shards.read_shards(spark, path)


@query("shard_union_years", """
    select case when o_orderdate < timestamp '1997-01-01' then 'orders_old' else 'orders_new' end as shard,
           o_orderkey from orders
""")
def shard_union_years(spark, sf_dir):
    """Two tables of one shape put together with their names."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    edge = F.lit("1997-01-01").cast("timestamp")
    return shards.union_shards({
        "orders_old": orders.where(F.col("o_orderdate") < edge),
        "orders_new": orders.where(F.col("o_orderdate") >= edge),
    }).select("shard", "o_orderkey")


@query("date_shard_write", """
    select strftime(d, '%Y%m%d') as shard_date, c_custkey, c_name
    from customer, (select unnest(generate_series(timestamp '2022-08-01', timestamp '2022-08-05',
                                                  interval 1 day)) as d)
""")
def date_shard_write(spark, sf_dir):
    """Five dated copies of the customer table."""
    path = fresh_dir(spark, "clones")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    copies = sink.clone_per_day(rows, "2022-08-01", "2022-08-05")
    sink.write_shards(copies, path, "shard_date", F.floor(F.col("c_custkey") / F.lit(1 << 20)))
    return shards.read_shards(spark, path)


_ROW = "o_orderkey bigint, o_orderstatus string, o_totalprice double"


def _envelopes(spark, sf_dir):
    """A snapshot of the early orders, then the changes that lead to the final table.

    Open orders get dearer, and finished ones of low priority are deleted.
    """
    orders = _orders(spark, sf_dir)
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    dearer = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    old = orders.where(F.col("o_orderdate") <= F.timestamp_micros(F.lit(CUT_US))).select(*cols)
    new = orders.where(~gone).withColumn("o_totalprice", dearer).select(*cols)
    key = F.coalesce(F.col("after.o_orderkey"), F.col("before.o_orderkey"))
    first = cdc.snapshot(old).withColumn("offset", key * 2)
    then = cdc.changes(old, new, ["o_orderkey"]).withColumn("offset", key * 2 + 1)
    return cdc.to_messages(first.unionByName(then), "offset")


@query("cdc_flatten", f"""
    with o as (select *, o_orderstatus = 'F' and o_orderpriority = '5-LOW' as gone,
                      o_orderdate <= timestamp '{CUT}' as early,
                      o_totalprice + case when o_orderstatus = 'P' then 100 else 0 end as price from orders)
    select o_orderkey * 2 as "offset", 'r' as op, null::double as before_price, o_totalprice as after_price
    from o where early
    union all
    select o_orderkey * 2 + 1, case when gone then 'd' when early then 'u' else 'c' end,
           case when early then o_totalprice end, case when not gone then price end
    from o where (early and gone) or (early and price <> o_totalprice) or (not early and not gone)
""")
def cdc_flatten(spark, sf_dir):
    flat = cdc.flatten(_envelopes(spark, sf_dir), _ROW, "offset")
    return flat.select("offset", "op", F.col("before.o_totalprice").alias("before_price"),
                       F.col("after.o_totalprice").alias("after_price"))


@query("cdc_apply", """
    select o_orderkey, o_orderstatus,
           o_totalprice + case when o_orderstatus = 'P' then 100 else 0 end as o_totalprice
    from orders where not (o_orderstatus = 'F' and o_orderpriority = '5-LOW')
""")
def cdc_apply(spark, sf_dir):
    flat = cdc.flatten(_envelopes(spark, sf_dir), _ROW, "offset")
    return cdc.apply_changes(flat, "o_orderkey", "offset")
