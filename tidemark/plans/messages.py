"""Topic scans, message encoding and decoding, JSON and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import jsonfn, textfn, timefn
from tidemark.operators.aggregates import tumbling_count
from tidemark.plans.common import (
    LINE_FIELDS, LINE_RECORD, STAMP_SQL, VALUE_SQL, event_log, events, log_lines, stored_log, table, window_start)
from tidemark.plans.registry import query
from tidemark.sinks import topic as sink
from tidemark.sources import tables as tab
from tidemark.sources import topic as src


@query("topic_scan", f"""
    select event_type as topic, event_id as "offset", epoch_us(ts) as ts_us,
           user_id::varchar as key, {VALUE_SQL} as value from events
""")
def topic_scan(spark, sf_dir):
    log = src.read_topic(spark, path=stored_log(spark, sf_dir))
    return log.select("topic", "offset", F.unix_micros("timestamp").alias("ts_us"), "key", "value")


@query("topic_multi_count", """
    select event_type as topic, count(*) as n from events
    where event_type in ('click', 'purchase') group by 1
""")
def topic_multi_count(spark, sf_dir):
    return src.message_counts(src.read_topic(spark, ["click", "purchase"], path=stored_log(spark, sf_dir)))


@query("topic_count", """
    select event_type as topic, count(*) as n from events group by 1
""")
def topic_count(spark, sf_dir):
    return src.message_counts(src.read_topic(spark, path=stored_log(spark, sf_dir)))


@query("table_count", """
    select 'customer' as name, count(*) as n from customer
    union all select 'orders', count(*) from orders
    union all select 'lineitem', count(*) from lineitem
""")
def table_count(spark, sf_dir):
    parts = [
        table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        for t in ("customer", "orders", "lineitem")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("topic_resume", """
    with half as (select event_type, max(event_id) // 2 as mark from events group by 1)
    select e.event_type as topic, e.event_id as "offset" from events e
    join half h on e.event_type = h.event_type and e.event_id > h.mark
""")
def topic_resume(spark, sf_dir):
    """A group that had read the first half of each topic goes on from its committed offsets."""
    path = stored_log(spark, sf_dir)
    log = src.read_topic(spark, path=path)
    halves = {r.topic: r.m // 2 for r in log.groupBy("topic").agg(F.max("offset").alias("m")).collect()}
    upto = F.create_map(*[F.lit(x) for kv in halves.items() for x in kv])
    committed = src.next_offsets(log.where(F.col("offset") <= upto[F.col("topic")]))
    return src.read_topic(spark, path=path, start=committed).select("topic", "offset")


@query("topic_encode", """
    select concat_ws('-', user_id, event_id) as key,
           to_json({'event_id': event_id, 'event_type': event_type, 'value': value})::varchar as value
    from events
""")
def topic_encode(spark, sf_dir):
    rows = sink.encode(
        events(spark, sf_dir), ["event_id", "event_type", "value"], sink.composite_key("user_id", "event_id")
    )
    return rows.select("key", "value")


@query("key_from_field", """
    select user_id::varchar as key, event_id from events
""")
def key_from_field(spark, sf_dir):
    return sink.key_from_field(events(spark, sf_dir), "user_id").select("key", "event_id")


@query("topic_route", """
    select 'db_nation' as topic, n_nationkey::bigint as id from nation
    union all select 'db_supplier', s_suppkey from supplier
    union all select 'db_customer', c_custkey from customer
    union all select 'db_orders', o_orderkey from orders
""")
def topic_route(spark, sf_dir):
    ids = {"nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(c).cast("bigint").alias("id"))
        for t, c in ids.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return sink.routed(rows, prefix="db_", table="source").select("topic", "id")


@query("multi_table", """
    select 'db_nation' as topic, to_json(t)::varchar as value from nation t
    union all select 'db_region', to_json(t)::varchar from region t
    union all select 'db_supplier', to_json(t)::varchar from supplier t
    union all select 'db_customer', to_json(t)::varchar from customer t
""")
def multi_table(spark, sf_dir):
    """All relational tables but those on the skip list, one topic each."""
    names = tab.chosen_tables(
        ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"],
        skip=["part", "orders", "lineitem"],
    )
    return tab.scan_tables(tab.parquet_tables(spark, sf_dir), names, prefix="db_")


@query("query_scan", """
    select o_custkey as id, count(*) as n, max(o_orderkey) as last_order
    from orders group by o_custkey
""")
def query_scan(spark, sf_dir):
    """Ingest the result of a query instead of a table."""
    return spark.sql(
        "select o_custkey as id, count(*) as n, max(o_orderkey) as last_order "
        "from {orders} group by o_custkey",
        orders=table(spark, sf_dir, "orders"),
    )


@query("insert_values", f"""
    select event_type as topic, epoch_us(ts) as ts_us, user_id::varchar as key, {VALUE_SQL} as value
    from events
    union all values ('refund', 1500, 'k17', '{{"paid":8}}'), ('refund', 1500, 'k18', null)
""")
def insert_values(spark, sf_dir):
    log = event_log(spark, sf_dir).select(
        "topic", F.unix_micros("timestamp").alias("ts_us"), "key", "value"
    )
    return src.insert_values(
        log, [("refund", 1500, "k17", '{"paid":8}'), ("refund", 1500, "k18", None)],
        "topic string, ts_us bigint, key string, value string",
    )


@query("format_json", """
    select event_id as "offset", event_id::varchar as event_id, user_id, event_type, value,
           cast(null as varchar) as ip from events
""")
def format_json(spark, sf_dir):
    """Declared columns; a number declared as text keeps its digits, an absent field is null."""
    return src.decode(
        event_log(spark, sf_dir).select("offset", "value"),
        "event_id string, user_id bigint, event_type string, value double, ip string",
    )


@query("format_raw", """
    select doc_id, text, strlen(text)::bigint as n_bytes from documents
""")
def format_raw(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("value"))
    return raw.select(
        "doc_id", F.decode("value", "UTF-8").alias("text"),
        F.octet_length("value").cast("bigint").alias("n_bytes"),
    )


@query("payload_fields", """
    select event_id as "offset", user_id::varchar as user_id, event_type, 2::bigint as n_fields from events
""")
def payload_fields(spark, sf_dir):
    message = F.to_json(F.struct(F.struct("event_id", "user_id", "event_type", "value").alias("payload")))
    fields = jsonfn.payload_fields(message, ["user_id", "event_type", "nickname"])
    return events(spark, sf_dir).select(F.col("event_id").alias("offset"), fields.alias("f")).select(
        "offset", F.col("f")["user_id"].alias("user_id"), F.col("f")["event_type"].alias("event_type"),
        F.size("f").cast("bigint").alias("n_fields"),
    )


@query("json_extract", """
    select event_id, json_extract_string(props, '$.k')::bigint as k, user_id::varchar as actor_user,
           upper(event_type) as domain from events
""")
def json_extract(spark, sf_dir):
    body = jsonfn.split_log_line(F.col("line"))[1]
    return log_lines(spark, sf_dir).select(
        "event_id",
        jsonfn.json_field(F.col("props"), "$.k").cast("bigint").alias("k"),
        jsonfn.json_field(body, "$.meta.visitor.number").alias("actor_user"),
        jsonfn.json_field(jsonfn.json_field(body, "$.event.parts"), "$[0].area").alias("domain"),
    )


@query("json_flatten", f"""
    select {STAMP_SQL} as reg_date, md5(event_id::varchar) as tran_id, user_id::varchar as actor_user,
           concat('v', user_id) as actor_name, event_type as action, upper(event_type) as info_domain,
           value::varchar as info_amount from events
""")
def json_flatten(spark, sf_dir):
    flat = jsonfn.flatten_log_lines(log_lines(spark, sf_dir), "line", LINE_RECORD, LINE_FIELDS)
    return flat.select(
        F.col("stamp").alias("reg_date"), F.col("trace").alias("tran_id"),
        F.col("visitor")["number"].alias("actor_user"), F.col("visitor")["label"].alias("actor_name"),
        F.col("verb").alias("action"), F.col("part")["area"].alias("info_domain"),
        F.col("part")["amount"].alias("info_amount"),
    )


@query("json_concat", f"""
    with lines as (select *, {STAMP_SQL} as reg from events)
    select event_id, json_extract_string(m, '$.stamp') as reg_date,
           json_extract_string(m, '$.event_id')::bigint as id, json_extract_string(m, '$.k')::bigint as k,
           json_extract_string(m, '$.kind') as kind
    from (select event_id, json_merge_patch(json_merge_patch(
            json_object('stamp', reg, 'kind', 'raw'), props),
            json_object('event_id', event_id, 'kind', event_type)) as m from lines)
""")
def json_concat(spark, sf_dir):
    rows = events(spark, sf_dir)
    head = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("stamp"), F.lit("raw").alias("kind")))
    tail = F.to_json(F.struct("event_id", F.col("event_type").alias("kind")))
    parts = rows.select("event_id", "props", head.alias("head"), tail.alias("tail"))
    first = parts.select("event_id", "tail", jsonfn.json_concat(F.col("head"), F.col("props")).alias("m"))
    merged = first.select("event_id", jsonfn.json_concat(F.col("m"), F.col("tail")).alias("m"))
    return merged.select(
        "event_id",
        F.from_json("m", "stamp string, event_id bigint, k bigint, kind string").alias("d"),
    ).select(
        "event_id", F.col("d.stamp").alias("reg_date"), F.col("d.event_id").alias("id"),
        F.col("d.k").alias("k"), F.col("d.kind").alias("kind"),
    )


@query("log_split", f"""
    select event_id, {STAMP_SQL} as reg_date,
           concat('{{"stamp": "', {STAMP_SQL}, '"}}') as head,
           length(to_json({{'meta': {{'trace': md5(event_id::varchar), 'visitor': {{'number': user_id,
             'label': concat('v', user_id)}}}}, 'event': {{'verb': event_type,
             'parts': [{{'area': upper(event_type), 'amount': value}}]}}}})::varchar) as body_chars
    from events
""")
def log_split(spark, sf_dir):
    stamp, body = jsonfn.split_log_line(F.col("line"))
    return log_lines(spark, sf_dir).select(
        "event_id", stamp.alias("reg_date"),
        F.concat(F.lit('{"stamp": "'), stamp, F.lit('"}')).alias("head"),
        F.length(body).cast("bigint").alias("body_chars"),
    )


@query("epoch_millis", """
    select event_id, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000 * 1000 as back_us from events
""")
def epoch_millis(spark, sf_dir):
    ms = timefn.epoch_ms(F.col("ts"))
    return events(spark, sf_dir).select(
        "event_id", ms.alias("ms"), F.unix_micros(timefn.from_epoch_ms(ms)).alias("back_us")
    )


@query("string_parts", """
    select event_id, split_part(email, '@', 1) as local_part, split_part(email, '@', 2) as domain,
           split_part(split_part(email, '@', 1), '-', 2) as step, starts_with(email, '1') as first_group
    from (select event_id, concat(user_id, '-', event_type, '@mail.com') as email from events)
""")
def string_parts(spark, sf_dir):
    email = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"), F.lit("@mail.com"))
    rows = events(spark, sf_dir).select("event_id", email.alias("email"))
    local = textfn.local_part(F.col("email"))
    return rows.select(
        "event_id", local.alias("local_part"), textfn.domain_part(F.col("email")).alias("domain"),
        F.split(local, "-")[1].alias("step"), F.startswith("email", F.lit("1")).alias("first_group"),
    )


@query("nan_filter", """
    select event_id, value from events where event_type <> 'signup'
""")
def nan_filter(spark, sf_dir):
    """NaN rows stay in the topic and are hidden from the stream view."""
    value = F.when(F.col("event_type") == "signup", F.lit(float("nan"))).otherwise(F.col("value"))
    topic = events(spark, sf_dir).select("event_id", value.alias("value"))
    return topic.where(~F.isnan("value"))


@query("time_label", """
    select event_id, strftime(ts - interval 1 minute, '%d%H%M') as previous_minute,
           strftime(ts + interval 1 day, '%Y%m%d') as next_day from events
""")
def time_label(spark, sf_dir):
    """The name suffix of the table that was closed a minute before each event, and of the next day's."""
    ts = F.col("ts")
    return events(spark, sf_dir).select(
        "event_id", timefn.shifted_label(ts, -1, "ddHHmm").alias("previous_minute"),
        timefn.shifted_label(ts, 24 * 60, "yyyyMMdd").alias("next_day"))


@query("promoted_count", """
    select epoch_us(date_trunc('hour', ts)) as window_start_us, event_type, count(*) as n
    from events group by all
""")
def promoted_count(spark, sf_dir):
    """A number in the message, epoch milliseconds, becomes the event time of the stream."""
    message = F.to_json(F.struct("event_type", timefn.epoch_ms(F.col("ts")).alias("regts")))
    log = events(spark, sf_dir).select(message.alias("value"))
    rows = src.decode(log, "event_type string, regts bigint")
    timed = rows.withColumn("ts", timefn.from_epoch_ms(F.col("regts")))
    return tumbling_count(timed, ["event_type"], "ts", "1 hour").select(window_start(), "event_type", "n")
