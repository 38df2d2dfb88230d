"""Sinks read back, schema versions, and benchmark results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.textfn import rates
from tidemark.operators import benchmarks, evolve
from tidemark.operators.evolve import Field
from tidemark.plans.common import VALUE_SQL, events, table
from tidemark.plans.registry import query
from tidemark.session import fresh_dir
from tidemark.sinks import files as sink
from tidemark.sources import files as src

ZONE = "Asia/Seoul"
EVENT_FIELDS = "event_id bigint, user_id bigint, event_type string, value double"


def _objects(spark, sf_dir, unit):
    path = fresh_dir(spark, "objects")
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts")
    sink.write_time_partitioned(
        rows, path, "ts", "event_id", ZONE, flush_size=100_000, unit=unit,
        columns=["event_id", "user_id", "event_type", "value"])
    return path


@query("sink_time_partition", """
    select strftime(l, '%Y') as year, strftime(l, '%m') as month, strftime(l, '%d') as day,
           strftime(l, '%H') as hour, count(*) as n, max(event_id) as last_id
    from (select *, ts + interval 9 hour as l from events) group by 1, 2, 3, 4
""")
def sink_time_partition(spark, sf_dir):
    """Events as gzip JSON below local-time folders, counted per folder."""
    parts = sink.time_partition_schema("hour")
    lines = src.read_json_lines(spark, _objects(spark, sf_dir, "hour"), EVENT_FIELDS, partitions=parts)
    return lines.groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("sink_roundtrip", """
    select event_id, user_id, event_type, value, true as valid from events
""")
def sink_roundtrip(spark, sf_dir):
    """Every line of the objects is valid JSON and equals the row that was written."""
    lines = src.read_json_lines(spark, _objects(spark, sf_dir, "day"), EVENT_FIELDS)
    return lines.select("event_id", "user_id", "event_type", "value",
                        F.col(src.CORRUPT).isNull().alias("valid"))


@query("log_write", f"""
    select {VALUE_SQL} as value from events
""")
def log_write(spark, sf_dir):
    """Events as JSON log lines in files of limited length, read back raw."""
    path = fresh_dir(spark, "logs")
    sink.write_log_lines(
        events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), path, 100_000)
    return src.read_log_lines(spark, path)


@query("table_roundtrip", """
    select s_suppkey, s_name, s_nationkey, s_acctbal from supplier
    union all select c_custkey, c_name, c_nationkey, c_acctbal from customer
""")
def table_roundtrip(spark, sf_dir):
    """Two appends to one table, read back."""
    path = fresh_dir(spark, "table")
    suppliers = table(spark, sf_dir, "supplier")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    sink.append_table(suppliers, path)
    sink.append_table(customers, path)
    return spark.read.parquet(path)


# The reader's schema; earlier versions lack some of the last fields.
READER = {
    "at": Field("string"),
    "kind": Field("string", "none"),
    "score": Field("double", -1.0),
    "visitor": Field("string", "nobody"),
}


def _versioned(spark, sf_dir):
    """Event messages of four schema versions, a new one every eight days; the last one changes a type.

    Some messages have a null field, some are tombstones, and some are no JSON.
    """
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")
    kind = F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("kind")
    score, visitor = F.col("value").alias("score"), F.col("user_id").alias("visitor")
    day = F.dayofmonth("ts")

    def record(*fields):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    value = (
        F.when(F.col("event_id") % 101 == 0, F.lit(None))
        .when(F.col("event_id") % 97 == 0, F.lit('{"at": "cut off'))
        .when(day <= 8, record(at, kind))
        .when(day <= 16, record(at, kind, score))
        .when(day <= 24, record(at, kind, score, visitor))
        .otherwise(record(at, kind, score, visitor.cast("string").alias("visitor")))
    )
    return events(spark, sf_dir).select(F.col("event_id").alias("offset"), value.alias("value"))


_SOUND = "event_id % 101 <> 0 and event_id % 97 <> 0"


@query("schema_evolve", f"""
    select event_id as "offset", strftime(ts, '%Y-%m-%d %H:%M:%S') as at,
           case when event_id % 50 <> 0 then event_type end as kind,
           case when day(ts) > 8 then value else -1 end as score,
           case when day(ts) > 16 then user_id::varchar else 'nobody' end as visitor
    from events where {_SOUND}
""")
def schema_evolve(spark, sf_dir):
    """Messages of all versions read with the newest schema; a null stays null."""
    return evolve.read_as(_versioned(spark, sf_dir), READER)


@query("schema_unreadable", f"""
    select event_id as "offset", case when event_id % 101 = 0 then 'tombstone' else 'malformed' end as problem
    from events where not ({_SOUND})
""")
def schema_unreadable(spark, sf_dir):
    """What is no record is kept apart, not read as a record of defaults."""
    return evolve.unreadable(_versioned(spark, sf_dir), READER).select("offset", "problem")


_SHAPES_SQL = f"""
    shapes as (select case when day(ts) <= 8 then 'at string,kind string'
                      when day(ts) <= 16 then 'at string,kind string,score double'
                      when day(ts) <= 24 then 'at string,kind string,score double,visitor bigint'
                      else 'at string,kind string,score double,visitor string' end as fields, event_id
               from events where {_SOUND}),
    registry as (select row_number() over (order by min(event_id)) as version, sha256(fields) as fingerprint,
                        fields, min(event_id) as first_offset, count(*) as n from shapes group by fields)
"""


@query("schema_versions", f"""
    with {_SHAPES_SQL} select * from registry
""")
def schema_versions(spark, sf_dir):
    """The registry of schemas found in the messages: one version per distinct set of typed fields."""
    found = evolve.schema_registry(_versioned(spark, sf_dir), "offset")
    return found.withColumn("fields", F.array_join("fields", ","))


@query("schema_compat", f"""
    with {_SHAPES_SQL},
    fields as (select version, split_part(f, ' ', 1) as field, split_part(f, ' ', 2) as type
               from (select version, unnest(string_split(fields, ',')) as f from registry)),
    steps as (select unnest(generate_series(2, (select max(version) from registry))) as version),
    pairs as (
        select s.version, coalesce(n.field, o.field) as field, n.type as now, o.type as before
        from steps s cross join (select distinct field from fields) a
        left join fields n on n.version = s.version and n.field = a.field
        left join fields o on o.version = s.version - 1 and o.field = a.field)
    select version, field,
           case when before is null then 'added' when now is null then 'removed' else 'retyped' end as change,
           case when before is null and field <> 'score' then 'READER_FIELD_MISSING_DEFAULT_VALUE'
                when now <> before and not (before = 'bigint' and now = 'double') then 'TYPE_MISMATCH' end as problem
    from pairs where now is distinct from before
""")
def schema_compat(spark, sf_dir):
    """Changes from version to version when only ``score`` has a default, judged by the write guard's rule."""
    registry = evolve.schema_registry(_versioned(spark, sf_dir), "offset")
    return evolve.field_changes(registry, {"score": READER["score"]})


_LINES_SQL = """
    lines as (select *, case event_type when 'click' then 'db' when 'view' then 'ct'
                        when 'purchase' then 'cdc' end as type,
                     case when value > 20 then 'ins' else 'sels' end as kind,
                     floor(value * 10)::bigint as rate from events)
"""


def _bench_lines(spark, sf_dir):
    """Benchmark output lines: rates of inserters and selectors among other text."""
    kind = F.when(F.col("value") > 20, "Inserter ").otherwise("Selector ")
    type_ = (F.when(F.col("event_type") == "click", "db").when(F.col("event_type") == "view", "ct")
             .when(F.col("event_type") == "purchase", "cdc"))
    rate = F.floor(F.col("value") * 10).cast("string")
    line = F.when(type_.isNotNull(), F.concat(
        kind, F.col("user_id").cast("string"), F.lit(" done. "), rate, F.lit(" rows per seconds."),
    )).otherwise(F.concat(F.lit("connect "), F.col("props")))
    epoch = F.floor((F.dayofmonth("ts") - 1) / 7) + 1
    return events(spark, sf_dir).select("event_id", type_.alias("type"), line.alias("line"), epoch.alias("epoch"))


@query("regex_metrics", f"""
    with {_LINES_SQL} select event_id, kind, rate from lines where type is not null
""")
def regex_metrics(spark, sf_dir):
    return rates(_bench_lines(spark, sf_dir), "line").select("event_id", "kind", "rate")


@query("bench_merge", f"""
    with {_LINES_SQL}
    select type as index, sum(rate) filter (kind = 'ins')::double / count(*) filter (kind = 'ins') as ins,
           sum(rate) filter (kind = 'sels')::double / count(*) filter (kind = 'sels') as sels
    from lines where type is not null group by 1
""")
def bench_merge(spark, sf_dir):
    path = fresh_dir(spark, "bench")
    merged = benchmarks.mean_rates(rates(_bench_lines(spark, sf_dir), "line"), "type")
    merged.coalesce(1).write.parquet(path)  # one row per benchmark type
    return spark.read.parquet(path)


@query("bench_union", f"""
    with {_LINES_SQL}
    select ((day(ts) - 1) // 7 + 1)::varchar as epoch, type as index, count(*) as n, max(rate) as best
    from lines where type is not null group by 1, 2
""")
def bench_union(spark, sf_dir):
    """Results of several epochs, read together; the epoch comes from the path."""
    path = fresh_dir(spark, "bench")
    found = rates(_bench_lines(spark, sf_dir), "line")
    best = found.groupBy("epoch", F.col("type").alias("index")).agg(
        F.count(F.lit(1)).alias("n"), F.max("rate").alias("best"))
    best.write.partitionBy("epoch").parquet(path)
    results = spark.read.option("recursiveFileLookup", True).parquet(path)
    return results.select("index", "n", "best", src.path_value(r"epoch=(\d+)/").alias("epoch"))
