"""Missing ids, duplicates, reconciliation, dedup, compaction and partition changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import audit, dedup, rekey
from tidemark.plans.common import VALUE_SQL, event_log, events, table
from tidemark.plans.generated import SENDS_SQL, deliveries
from tidemark.plans.registry import query
from tidemark.session import fresh_dir
from tidemark.sinks.compact import StoredLog


@query("missing_ids", """
    select i.id as event_id from (select unnest(generate_series(
        (select min(event_id) from events), (select max(event_id) from events))) as id) i
    where i.id not in (select event_id from events where event_type <> 'error')
""")
def missing_ids(spark, sf_dir):
    """Ids of the whole range that a consumer which lost the errors has not seen."""
    rows = events(spark, sf_dir)
    first, last = rows.agg(F.min("event_id"), F.max("event_id")).first()
    return audit.missing_ids(rows.where(F.col("event_type") != "error"), "event_id", first, last)


@query("id_gaps", """
    with seen as (select distinct event_id as id from events where event_type = 'click'
                  union all select max(event_id) + 1 from events),
    placed as (select id, coalesce(lag(id) over (order by id), (select min(event_id) from events) - 1) + 1 as low from seen)
    select low as first_missing, id - 1 as last_missing, id - low as n from placed where id > low
""")
def id_gaps(spark, sf_dir):
    """The runs of ids that a consumer of clicks alone has not seen."""
    rows = events(spark, sf_dir)
    first, last = rows.agg(F.min("event_id"), F.max("event_id")).first()
    return audit.id_gaps(rows.where("event_type = 'click'"), "event_id", first, last)


@query("duplicate_report", f"""
    with {SENDS_SQL}
    select event_id, delivery, epoch_us(emit_ts) as emit_us, count(*) over (partition by event_id) as n
    from delivered qualify n > 1
""")
def duplicate_report(spark, sf_dir):
    sent = deliveries(spark, sf_dir).select("event_id", "delivery", F.unix_micros("emit_ts").alias("emit_us"))
    return audit.duplicate_report(sent, "event_id", ["delivery", "emit_us"])


@query("duplicate_rate", f"""
    with {SENDS_SQL}
    select cast(sum(n) as bigint) as messages, cast(sum(n - 1) as bigint) as surplus,
           sum(n - 1)::double * 100.0::double / sum(n)::double as percent
    from (select event_id, count(*) as n from delivered group by 1)
""")
def duplicate_rate(spark, sf_dir):
    return audit.duplicate_rate(deliveries(spark, sf_dir), "event_id")


@query("reconcile_counts", """
    select coalesce(o.k, l.k) as orderkey, coalesce(o.n, 0) as source_n, coalesce(l.n, 0) as sink_n,
           case when coalesce(o.n, 0) = coalesce(l.n, 0) then 'ok'
                when coalesce(o.n, 0) > coalesce(l.n, 0) then 'missing' else 'duplicate' end as status
    from (select o_orderkey as k, count(*) as n from orders group by 1) o
    full outer join (select l_orderkey as k, count(*) as n from lineitem group by 1) l on o.k = l.k
""")
def reconcile_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return audit.reconcile_counts(orders, lines, ["orderkey"])


DEDUP_SQL = """
    select event_id, user_id, event_type, value, copies from (
        select *, row_number() over w as rn,
               count(*) over (partition by user_id, event_type, date_trunc('hour', ts)) as copies
        from events window w as (partition by user_id, event_type, date_trunc('hour', ts) order by event_id))
    where rn = 1
"""


@query("dedup_windowed", DEDUP_SQL)
def dedup_windowed(spark, sf_dir):
    """First event per user, type and hour."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts")
    return dedup.dedup_windowed(rows, ["user_id", "event_type"], "ts", "1 hour", "event_id").drop("ts")


@query("dedup_deliveries", f"""
    with {SENDS_SQL},
    ranked as (select *, row_number() over (
        partition by event_id, user_id, date_trunc('minute', emit_ts)
        order by emit_ts, delivery) as rn from delivered)
    select event_id, user_id, epoch_us(emit_ts) as emit_us, delivery from ranked where rn = 1
""")
def dedup_deliveries(spark, sf_dir):
    """Repeated deliveries removed within one minute; a repeat in the next minute passes."""
    sent = deliveries(spark, sf_dir).drop("ts")
    place = sent.withColumn("place", F.struct("emit_ts", "delivery"))
    kept = dedup.dedup_windowed(place, ["event_id", "user_id"], "emit_ts", "1 minute", "place")
    return kept.select("event_id", "user_id", F.unix_micros("emit_ts").alias("emit_us"), "delivery")


def _user_log(spark, sf_dir):
    """Event types keyed by user; an error event is a tombstone."""
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    return events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("offset"), value.alias("value"))


@query("compact_log", """
    select user_id as key, max(event_id) as "offset",
           arg_max(event_type, event_id) as value from events where user_id is not null group by 1
""")
def compact_log(spark, sf_dir):
    log = events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.col("event_type").alias("value"))
    return dedup.compact_log(log)


@query("compact_log_head", """
    with cut as (select max(event_id) // 2 as edge from events)
    select user_id as key, max(event_id) as "offset", arg_max(event_type, event_id) as value
    from events, cut where event_id < edge and user_id is not null group by 1
    union all select user_id, event_id, event_type from events, cut where event_id >= edge
""")
def compact_log_head(spark, sf_dir):
    """Only the closed half of the log is compacted; the head keeps its repeats."""
    log = events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.col("event_type").alias("value"))
    newest = log.agg(F.max("offset")).first()[0]
    return dedup.compact_log(log, closed_upto=newest // 2)


@query("compact_tombstone", """
    select user_id as key, max(event_id) as "offset", max_by(event_type, event_id) as value
    from events where user_id is not null group by 1 having value <> 'error'
""")
def compact_tombstone(spark, sf_dir):
    return dedup.compact_log(_user_log(spark, sf_dir))


@query("rekey", """
    select event_type as key, count(*) as n, max(event_id) as last_offset from events group by 1
""")
def rekey_by_type(spark, sf_dir):
    """Key the user-keyed stream by event type and aggregate on the new key."""
    log = event_log(spark, sf_dir).select("key", "topic", "offset")
    keyed = rekey.rekey(log, F.col("topic"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset"))


_BYTES = "[ord(substr(s, i, 1))::ubigint for i in range(1, length(s) + 1)]"
_M = "1540483477::ubigint"
_MASK = "4294967295::ubigint"


def _mul(x: str) -> str:
    return f"((({x}) * {_M}) & {_MASK})"


def _word_sql(i: str) -> str:
    parts = " | ".join(f"(coalesce(b[4 * ({i}) + {k + 1}], 0) << {8 * k})" for k in range(4))
    return f"(({parts})::ubigint)"


_K = _mul(_word_sql("i"))
_MIXED = _mul(f"xor({_K}, {_K} >> 24)")

# the same hash for ASCII keys, written over lists of bytes
PARTITION_SQL = f"""
    hashed as (
        select *, list_reduce([xor(2538058380::ubigint, length(s)::ubigint)] ||
                   [{_MIXED} for i in range(0, length(s) // 4)],
                   lambda h, k: xor({_mul('h')}, k)) as h0
        from (select *, {_BYTES} as b from keyed)),
    tailed as (select *, case when length(s) % 4 = 0 then h0
                 else {_mul('xor(h0, ' + _word_sql('length(s) // 4') + ')')} end as h1 from hashed),
    mixed as (select *, {_mul('xor(h1, h1 >> 13)')} as h2 from tailed),
    placed as (select *, ((xor(h2, h2 >> 15) & 2147483647) % 4)::int as part from mixed)
"""


@query("repartition_keys", f"""
    with numbered as (
      select event_type as topic, user_id % 12 as source, user_id::varchar as s, event_id,
             row_number() over (partition by event_type, user_id % 12 order by event_id) - 1 as old
      from events),
    keyed as (select * from numbered), {PARTITION_SQL},
    moved as (
      select topic, part, s, event_id,
             row_number() over (partition by topic, part order by old, source) - 1 as "offset" from placed)
    select topic, part as partition, "offset", s as key, event_id::varchar as value,
           row_number() over (partition by topic, part, s order by "offset") as position
    from moved
""")
def repartition_keys(spark, sf_dir):
    """Topics of twelve partitions moved to four each by key hash, order kept per key."""
    source = Window.partitionBy("event_type", "source").orderBy("event_id")
    log = events(spark, sf_dir).withColumn("source", F.pmod("user_id", F.lit(12)).cast("int")).select(
        F.col("event_type").alias("topic"), F.col("source").alias("partition"),
        (F.row_number().over(source) - 1).cast("bigint").alias("offset"),
        F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))
    return rekey.key_positions(rekey.repartition_topic(log, 4))


@query("compact_stored_log", f"""
    with log as (
      select event_type as topic, event_id as "offset",
        case when event_type = 'view' then event_id else user_id end::varchar as key, {VALUE_SQL} as value from events),
    marked as (select *, "offset" < max("offset") over (partition by topic) + 1 - 500 as closed from log),
    ranked as (
      select *, row_number() over (partition by topic, key, closed order by "offset" desc) as back,
        count(*) filter (closed) over (partition by topic) as n from marked),
    shares as (select topic, 1 - count(*) filter (closed and back = 1) * 1.0 / any_value(n) as old from ranked group by 1)
    select topic, "offset", key, value from ranked join shares using (topic) where not closed or back = 1 or old <= 0.5
""")
def compact_stored_log(spark, sf_dir):
    """Topics with mostly old messages are rewritten, the one with a key for each message is left alone, and so are heads."""
    log = StoredLog(spark, fresh_dir(spark, "stored"))
    key = F.when(F.col("topic") == "view", F.col("offset").cast("string")).otherwise(F.col("key"))
    log.append(event_log(spark, sf_dir, partitions=1).withColumn("key", key))
    log.compact(head=500)
    return log.read().select("topic", "offset", "key", "value")
