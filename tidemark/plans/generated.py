"""Generated people, writer tables, injected anomalies, and what arrives late."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.audit import late_rows as late_rows_of
from tidemark.plans.common import events, table
from tidemark.plans.registry import query
from tidemark.sources import generate as gen


def _slot(i: int) -> str:
    return f"('0x' || substr(h, {4 * i + 1}, 4))::bigint"


def _pick(words: list[str], number: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{listed}], {number} % {len(words)} + 1)"


PERSON_SQL = f"""
    {_pick(gen.FIRST_NAMES, _slot(0))} || ' ' || {_pick(gen.LAST_NAMES, _slot(1))} as name,
    ({_slot(2)} % 999 + 1) || ' ' || {_pick(gen.STREETS, _slot(3))} || ' Street, '
        || {_pick(gen.CITIES, _slot(4))} as address,
    ({_slot(5)} % 89 + 11) || '.' || ({_slot(6)} % 256) || '.' || ({_slot(6)} // 256) || '.'
        || ({_slot(7)} % 254 + 1) as ip,
    strftime(date '1950-01-01' + ({_slot(7)} % 20000)::int, '%Y-%m-%d') as birth,
    {_pick(gen.LAST_NAMES, _slot(1))} || ' ' || {_pick(gen.COMPANY_KINDS, _slot(2))} as company,
    '010-' || lpad({_slot(5)}::varchar, 5, '0') || '-' || lpad({_slot(6)}::varchar, 5, '0') as phone
"""


@query("gen_person", f"""
    select id, {PERSON_SQL}, 1664925600000::bigint as regts
    from (select c_custkey as id, md5(concat('42:', c_custkey)) as h from customer)
""")
def gen_person(spark, sf_dir):
    """A made-up person for every customer, registered at one fixed time."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    fixed = F.timestamp_millis(F.lit(1664925600000))
    return gen.with_person(ids, "id", seed=42, at=fixed).select(*gen.PERSON_FIELDS, "regts")


@query("gen_person_table", f"""
    select id, (id % 10)::int as pid, id // 10 as sid, id // 10 // 100 as epoch, {PERSON_SQL}
    from (select o_orderkey as id, md5(concat('42:', o_orderkey)) as h from orders)
""")
def gen_person_table(spark, sf_dir):
    """Rows written by ten writers in batches of one hundred, one row per order."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    rows = gen.with_person(gen.writer_slots(ids, "id", writers=10, batch=100), "id", seed=42)
    return rows.select("pid", "sid", "epoch", *gen.PERSON_FIELDS)


SENDS_SQL = """
    sends as (
        select *, ('0x' || substr(md5(concat('dup0:', event_id)), 1, 8))::bigint < floor(0.2 * 4294967296) as dup,
               ('0x' || substr(md5(concat('lag0:', event_id)), 1, 8))::bigint < floor(0.1 * 4294967296) as lag
        from events),
    delivered as (
        select event_id, user_id, ts, ts as emit_ts, 'normal' as delivery from sends where dup or not lag
        union all select event_id, user_id, ts, ts + interval 3 second, 'duplicate' from sends where dup
        union all select event_id, user_id, ts, ts + interval 2 hour, 'late' from sends where not dup and lag)
"""


def deliveries(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return gen.inject_anomalies(
        rows, "event_id", "ts", dup_rate=0.2, lag_rate=0.1, dup_delay="3 seconds", lag_delay="2 hours"
    )


@query("inject_anomalies", f"""
    with {SENDS_SQL} select event_id, epoch_us(emit_ts) as emit_us, delivery from delivered
""")
def inject_anomalies(spark, sf_dir):
    return deliveries(spark, sf_dir).select(
        "event_id", F.unix_micros("emit_ts").alias("emit_us"), "delivery"
    )


@query("late_rows", f"""
    with {SENDS_SQL},
    seen as (select *, max(ts) over (order by emit_ts, event_id, delivery rows unbounded preceding) as newest
             from delivered)
    select event_id, delivery, epoch_us(newest) - epoch_us(ts) as behind_us
    from seen where ts < newest - interval 1 hour
""")
def late_rows(spark, sf_dir):
    """Deliveries whose event time is over an hour behind the newest one already delivered."""
    return late_rows_of(
        deliveries(spark, sf_dir), "ts", ["emit_ts", "event_id", "delivery"], "1 hour"
    ).select("event_id", "delivery", "behind_us")
