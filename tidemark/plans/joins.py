"""Stream-stream and stream-table joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.plans.common import events
from tidemark.plans.registry import query


def _of_type(spark, sf_dir, kind):
    return events(spark, sf_dir).where(F.col("event_type") == kind)


@query("within_join", """
    select p.user_id, p.event_id as purchase_id, c.event_id as click_id,
           epoch_us(c.ts) - epoch_us(p.ts) as apart_us
    from events p join events c on p.user_id = c.user_id
     and c.ts between p.ts - interval 1 hour and p.ts + interval 1 hour
    where p.event_type = 'purchase' and c.event_type = 'click'
""")
def within_join(spark, sf_dir):
    purchases = _of_type(spark, sf_dir, "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    clicks = _of_type(spark, sf_dir, "click").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    pairs = j.within_join(purchases, clicks, ["user_id"], "bought", "clicked", "1 hour")
    apart = F.unix_micros("clicked") - F.unix_micros("bought")
    return pairs.select("user_id", "purchase_id", "click_id", apart.alias("apart_us"))


LATEST_SQL = """
    select p.event_id, p.user_id, p.value as paid, c.value
    from events p join (
        select user_id, arg_max(value, event_id) as value from events
        where event_type = 'click' and user_id is not null group by 1) c on p.user_id = c.user_id
    where p.event_type = 'purchase'
"""


@query("join_latest", LATEST_SQL)
def join_latest(spark, sf_dir):
    purchases = _of_type(spark, sf_dir, "purchase").select(
        "event_id", "user_id", F.col("value").alias("paid"))
    clicks = _of_type(spark, sf_dir, "click").select("event_id", "user_id", "value")
    return j.join_latest(purchases, clicks, ["user_id"], ["value"], "event_id", ["event_id"])


ASOF_SQL = """
    select p.event_id, p.user_id, p.value as paid, c.value
    from (select * from events where event_type = 'purchase') p
    asof left join (select * from events where event_type = 'click') c
      on p.user_id = c.user_id and p.event_id >= c.event_id
"""


def asof_purchases(spark, sf_dir):
    log = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "click")).select(
        "event_id", "user_id", "event_type", "value", F.col("value").alias("paid"))
    joined = j.asof_in_log(log, F.col("event_type") == "purchase", ["user_id"], ["event_id"], ["value"])
    return joined.select("event_id", "user_id", "paid", "value")


@query("join_asof_left", ASOF_SQL)
def join_asof_left(spark, sf_dir):
    """Each purchase with the last click value its user had when it arrived."""
    return asof_purchases(spark, sf_dir)


# clicks with a value above 5 are stamped two days back, so event time and arrival order differ
@query("join_asof_event_time", """
    with log as (
        select event_id, user_id, event_type, value,
               case when event_type = 'click' and value > 5 then ts - interval 2 day else ts end as stamped
        from events where event_type in ('purchase', 'click')),
    filled as (
        select *, last_value(case when event_type = 'click' then value end ignore nulls) over (
            partition by user_id order by stamped, event_id rows unbounded preceding) as known
        from log)
    select event_id, user_id, value as paid, known as value from filled where event_type = 'purchase'
""")
def join_asof_event_time(spark, sf_dir):
    """The same join ordered by event time instead of arrival."""
    back = F.when(F.col("value") > 5, F.col("ts") - F.expr("interval 2 days")).otherwise(F.col("ts"))
    purchases = _of_type(spark, sf_dir, "purchase").select(
        "event_id", "user_id", F.col("value").alias("paid"), F.unix_micros("ts").alias("at"))
    clicks = _of_type(spark, sf_dir, "click").select(
        "event_id", "user_id", "value", F.unix_micros(back).alias("at"))
    joined = j.asof_join(purchases, clicks, ["user_id"], ["at", "event_id"], ["value"], dense=False)
    return joined.select("event_id", "user_id", "paid", "value")


@query("fillna_earliest", f"""
    with joined as ({ASOF_SQL}),
    first as (select user_id, arg_min(value, event_id) as value from events
              where event_type = 'click' group by 1)
    select a.event_id, a.user_id, a.paid, coalesce(a.value, f.value) as value
    from joined a left join first f on a.user_id = f.user_id
""")
def fillna_earliest(spark, sf_dir):
    """Purchases before the user's first click take that first click's value."""
    clicks = _of_type(spark, sf_dir, "click").select("event_id", "user_id", "value")
    return j.fill_earliest(
        asof_purchases(spark, sf_dir), clicks, ["user_id"], ["value"], "event_id", ["event_id"])
