"""Polls, shards, change capture, sinks and schema versions."""

import gzip
import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import evolve
from tidemark.operators.evolve import Field
from tidemark.session import fresh_dir
from tidemark.sinks import files as sink
from tidemark.sinks.topic import encode
from tidemark.sources import cdc, files, generate, shards
from tidemark.sources.poll import Mark, next_mark, poll, poll_batches, unseen, untimed
from tidemark.streaming.ingest import TablePoller, poll_tables


def people(spark, n, at_ms=1000):
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("name"), "id").alias("name"), F.timestamp_millis(F.lit(at_ms)).alias("regdt"))


def renamed(df, **more):
    hit = F.col("id") == 1
    return df.withColumns({"name": F.when(hit, "MODIFIED").otherwise(F.col("name"))} | {
        c: F.when(hit, v).otherwise(F.col(c)) for c, v in more.items()})


def test_id_polls_do_not_see_updates_or_reused_ids(spark):
    poller = TablePoller(fresh_dir(spark, "t"), id_col="id")
    got = poller.run([
        lambda: people(spark, 10),
        lambda: renamed(people(spark, 10)),
        lambda: renamed(people(spark, 11)),
        lambda: people(spark, 15).withColumn("name", F.lit("after reset")),
    ])
    assert rows(got.groupBy("poll").count()) == [(1, 10), (3, 1), (4, 4)]
    assert rows(got.where("id = 1"), "name") == [("name1",)]
    assert got.count() == 15


def test_time_and_id_polls_deliver_updated_rows_again(spark):
    poller = TablePoller(fresh_dir(spark, "t"), id_col="id", ts_col="regdt")
    later = F.timestamp_millis(F.lit(2000))
    got = poller.run([lambda: people(spark, 10), lambda: renamed(people(spark, 10), regdt=later)])
    assert got.count() == 11
    assert rows(got.where("id = 1"), "name") == [("MODIFIED",), ("name1",)]


def test_a_failed_poll_is_repeated_in_place(spark):
    poller = TablePoller(fresh_dir(spark, "t"), id_col="id")
    poller.run_once(people(spark, 3))
    people(spark, 9).write.parquet(f"{poller.path}/data/poll=2")  # rows written, mark not
    assert poller.run_once(people(spark, 5)) == 2
    assert rows(spark.read.parquet(f"{poller.path}/data"), "id") == [(i,) for i in range(1, 6)]


def test_batched_poll(spark):
    got = poll(people(spark, 10), Mark(id=2), id_col="id", batch=3)
    assert rows(got, "id") == [(3,), (4,), (5,)]
    assert next_mark(got, Mark(), id_col="id") == Mark(id=5)
    assert next_mark(got.limit(0), Mark(id=5), id_col="id") == Mark(id=5)


def tied(spark, n):
    return spark.range(1, n + 1).select("id", F.timestamp_millis(F.lit(1000)).alias("regdt"))


def test_tied_times_are_lost_without_a_delay(spark):
    first = poll(tied(spark, 1), Mark(), ts_col="regdt", now_us=2_000_000)
    mark = next_mark(first, Mark(), ts_col="regdt")
    assert poll(tied(spark, 2), mark, ts_col="regdt", now_us=7_000_000).count() == 0


def test_a_delay_waits_for_tied_times(spark):
    kw = {"ts_col": "regdt", "delay_us": 8_000_000}
    assert poll(tied(spark, 1), Mark(), now_us=2_000_000, **kw).count() == 0
    assert poll(tied(spark, 2), Mark(), now_us=9_000_000, **kw).count() == 2


def test_inclusive_poll(spark):
    first = poll(tied(spark, 1), Mark(), ts_col="regdt")
    mark = next_mark(first, Mark(), ts_col="regdt")
    again = poll(tied(spark, 2), mark, ts_col="regdt", inclusive=True)
    assert again.count() == 2 and rows(unseen(again, first, mark, "regdt", ["id"]), "id") == [(2,)]


def test_poll_batches(spark):
    df = people(spark, 25).withColumn("regdt", F.timestamp_seconds(F.col("id") % 2))
    order = sorted(range(1, 26), key=lambda i: (i % 2, i))
    for limits in ({}, {"hot_rows": 1, "segment_rows": 4}):
        got = dict(rows(poll_batches(df, "regdt", "id", 10, **limits), "id", "poll"))
        assert got == {i: n // 10 for n, i in enumerate(order)}


def test_poll_is_pushed_to_the_scan(spark):
    path = fresh_dir(spark, "t")
    people(spark, 10).write.parquet(path)
    table = spark.read.parquet(path)
    plan = poll(table, Mark(id=5, ts_us=7), id_col="id", ts_col="regdt").select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(regdt" in plan


MACRO = """
    SELECT * FROM person_{{ MinAddFmt -1 ddHHmm }} UNION ALL SELECT * FROM person_now
-----
    SELECT * FROM person_now
"""


def test_rotation(spark):
    writers = spark.range(65).select(F.col("id").alias("pid"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("sid"))
    now = datetime(2022, 8, 11, 0, 0, 1)
    writers.createOrReplaceTempView("person_now")
    assert shards.rotated_scan(spark, MACRO, now).count() == 6500  # nothing rotated yet
    writers.where("pid < 30").createOrReplaceTempView("person_102359")
    writers.where("pid >= 30").createOrReplaceTempView("person_now")
    got = shards.rotated_scan(spark, MACRO, now)
    assert got.count() == 6500 and got.select("pid").distinct().count() == 65
    with pytest.raises(Exception):
        shards.rotated_scan(spark, "SELECT * FROM person_{{ MinAddFmt 5 ddHHmm }}", now)


def test_dated_clones(spark):
    path = fresh_dir(spark, "t")
    copies = sink.clone_per_day(spark.range(10), "2022-08-30", "2022-09-01")
    sink.write_shards(copies, path, "shard_date", F.floor(F.col("id") / 4))
    assert rows(shards.read_shards(spark, path).groupBy("shard_date").count()) == [
        ("20220830", 10), ("20220831", 10), ("20220901", 10)]
    part = shards.read_shards(spark, path, "20220831", "20220831")
    assert part.count() == 10 and "PartitionFilters: [" in part._jdf.queryExecution().toString()


def test_change_capture(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, "e")], "id int, v string")
    env = cdc.snapshot(old).withColumn("offset", F.col("after.id").cast("bigint")).unionByName(
        cdc.changes(old, new, ["id"]).withColumn("offset", F.lit(100) + F.coalesce("after.id", "before.id")))
    flat = cdc.flatten(cdc.to_messages(env, "offset"), "id int, v string", "offset")
    assert rows(flat.where("offset >= 100"), "offset", "op") == [(102, "u"), (103, "d"), (104, "u"), (105, "c")]
    assert rows(cdc.apply_changes(flat, "id", "offset")) == rows(new)


def test_objects_by_minute(spark):
    path = fresh_dir(spark, "t")
    df = generate.with_person(spark.range(1, 41), "id").withColumn("ts", F.timestamp_seconds(F.col("id") * 4))
    sink.write_time_partitioned(df, path, "ts", "id", "Asia/Seoul", flush_size=6)
    found = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".gz")]
    assert all("/year=1970/month=01/day=01/hour=09/minute=0" in f for f in found)
    sizes = [len(gzip.open(f).read().splitlines()) for f in found]
    assert sum(sizes) == 40 and max(sizes) <= 6
    got = files.read_json_lines(spark, path, "id bigint, name string", partitions=sink.time_partition_schema())
    assert rows(got.groupBy("minute").count()) == [("00", 14), ("01", 15), ("02", 11)]
    assert rows(files.count_valid(files.read_json_lines(spark, path, "id bigint"))) == [(40, 0)]


def test_invalid_lines_are_found(spark):
    path = fresh_dir(spark, "t")
    os.makedirs(f"{path}/deep")
    with gzip.open(f"{path}/deep/x.gz", "wt") as f:
        f.write('{"id": 1}\n\n{"id": \n')
    with open(f"{path}/deep/x.txt", "w") as f:
        f.write("not read\n")
    lines = files.read_json_lines(spark, path, "id bigint")
    assert rows(files.count_valid(lines)) == [(1, 1)]


def test_log_files_have_limited_length(spark):
    path = fresh_dir(spark, "t")
    sink.write_log_lines(spark.range(100).coalesce(1), path, lines_per_file=30)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == 4
    assert rows(files.read_log_lines(spark, path))[0] == ('{"id":0}',)



def test_mixed_version_reads(spark):
    msgs = spark.createDataFrame([
        (1, '{"seat":4}'), (2, '{"seat":5,"meal":"soup"}'), (3, '{"meal":"rice","seat":6,"wifi":true}'), (4, '{"seat":7,"meal":null}')],
        "n int, value string")
    one = {"seat": Field("int")}
    two = one | {"meal": Field("string", "any")}
    three = two | {"wifi": Field("boolean", False)}
    assert rows(evolve.read_as(msgs, one)) == [(1, 4), (2, 5), (3, 6), (4, 7)]
    assert rows(evolve.read_as(msgs, two)) == [(1, 4, "any"), (2, 5, "soup"), (3, 6, "rice"), (4, 7, None)]
    assert rows(evolve.read_as(msgs, three)) == [
        (1, 4, "any", False), (2, 5, "soup", False), (3, 6, "rice", True), (4, 7, None, False)]


PARCEL = {"code": Field("bigint"), "weight": Field("float"), "label": Field("string")}
TYPES = ["int", "bigint", "float", "double", "string", "boolean"]


def test_one_rule_for_each_kind_of_change():
    lacks = evolve.READER_FIELD_MISSING_DEFAULT_VALUE
    assert evolve.problems(PARCEL, PARCEL) == []
    assert evolve.problems(PARCEL, PARCEL | {"depot": Field("int")}) == [("depot", lacks)]
    assert evolve.problems(PARCEL, PARCEL | {"depot": Field("int", 0), "note": Field("string", None)}) == []
    assert evolve.problems(PARCEL, {"code": PARCEL["code"]}) == []
    assert sorted(evolve.problems({}, PARCEL)) == [(n, lacks) for n in ("code", "label", "weight")]


@pytest.mark.parametrize("old", TYPES)
@pytest.mark.parametrize("new", TYPES)
def test_only_wider_types_can_be_read(old, new):
    numbers = ["int", "bigint", "float", "double"]
    fits = old == new or (old in numbers and new in numbers and numbers.index(old) < numbers.index(new))
    assert (evolve.problems({"x": Field(old)}, {"x": Field(new)}) == []) == fits


def test_modes_and_guard():
    more = PARCEL | {"depot": Field("int")}
    assert evolve.incompatible(PARCEL, more, "FORWARD") == [] and evolve.incompatible(more, PARCEL) == []
    assert evolve.incompatible(more, PARCEL, "FULL") == [("depot", evolve.READER_FIELD_MISSING_DEFAULT_VALUE)]
    with pytest.raises(ValueError, match="depot"):
        evolve.ensure_compatible(PARCEL, more)
    evolve.ensure_compatible(more, PARCEL)
    with pytest.raises(ValueError):
        evolve.incompatible(PARCEL, more, "SIDEWAYS")


MESSAGES = [
    (0, '{"code":1,"weight":2.5}'), (1, '{"weight":3.0,"code":4}'), (2, '{"code":null,"weight":1.5}'), (3, '{"code":7}'),
    (4, '{"code":"x","weight":2.5}'), (5, "not json"), (6, None), (7, '[1,2]'), (8, '{"code":8'), (9, '{"weight":1.0,"tag":{"a":[1]}}')]


def test_registry_knows_types_and_leaves_out_what_is_no_record(spark):
    reg = evolve.schema_registry(spark.createDataFrame(MESSAGES, "offset bigint, value string"), "offset")
    # a null code could be either of two types there, so it is a shape of its own
    assert [(r.version, list(r.fields), r.first_offset, r.n) for r in reg.orderBy("version").collect()] == [
        (1, ["code bigint", "weight double"], 0, 2), (2, ["code null", "weight double"], 2, 1), (3, ["code bigint"], 3, 1),
        (4, ["code string", "weight double"], 4, 1), (5, ["tag object<a: array<bigint>>", "weight double"], 9, 1)]
    changes = evolve.field_changes(reg, {"weight": Field("double", 0.0)}).where("version >= 3")
    assert rows(changes, "version", "field", "change", "problem") == [
        (3, "code", "retyped", evolve.TYPE_MISMATCH), (3, "weight", "removed", None),
        (4, "code", "retyped", evolve.TYPE_MISMATCH), (4, "weight", "added", None),
        (5, "code", "removed", None), (5, "tag", "added", evolve.READER_FIELD_MISSING_DEFAULT_VALUE)]


def test_a_null_takes_the_type_of_the_field(spark):
    msgs = spark.createDataFrame([(0, '{"a":null}'), (1, '{"a":2}')], "offset bigint, value string")
    assert [list(r.fields) for r in evolve.schema_registry(msgs, "offset").collect()] == [["a bigint"]]


def test_no_record_is_invented(spark):
    msgs = spark.createDataFrame(MESSAGES, "offset bigint, value string")
    schema = {"weight": Field("double"), "code": Field("bigint", -1)}
    assert rows(evolve.read_as(msgs, schema), "offset", "code", "weight") == [
        (0, 1, 2.5), (1, 4, 3.0), (2, None, 1.5), (9, -1, 1.0)]
    assert rows(evolve.unreadable(msgs, schema), "offset", "problem") == [
        (3, "missing weight"), (4, "malformed"), (5, "malformed"), (6, "tombstone"), (7, "malformed"), (8, "malformed")]


def test_null_fields_survive_encoding(spark):
    df = encode(spark.createDataFrame([(1, None)], "n int, tag string"), ["n", "tag"])
    assert rows(df, "value") == [('{"n":1,"tag":null}',)]
    assert rows(evolve.read_as(df.select("value"), {"n": Field("int"), "tag": Field("string", "?")})) == [(1, None)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_batched_time_polls_lose_nothing(spark, tmp_path, inclusive):
    """Ties larger than the batch stay together, and a poll goes on where the last one ended."""
    data = [(i, datetime(2020, 1, 1 + (i // 4))) for i in range(10)] + [(50 + i, datetime(2020, 2, 1)) for i in range(9)]
    table = spark.createDataFrame(data, "id long, at timestamp")
    options = {"inclusive": True, "identity": ["id"]} if inclusive else {}
    got = TablePoller(f"{tmp_path}/p{inclusive}", ts_col="at", batch=3, **options).run_until_empty(table)
    assert rows(got, "id") == [(i,) for i, _ in data]
    assert rows(got.groupBy("at").agg(F.countDistinct("poll").alias("n")).where("n > 1")) == []


def test_inclusive_batches_pass_a_mark_that_fills_a_batch(spark):
    table = spark.createDataFrame([(i, datetime(2020, 1, 1 + i // 5)) for i in range(10)], "id long, at timestamp")
    first = poll(table, Mark(), ts_col="at", batch=2, inclusive=True)
    mark = next_mark(first, Mark(), ts_col="at")
    late = table.union(spark.createDataFrame([(99, datetime(2020, 1, 1))], "id long, at timestamp"))
    second = poll(late, mark, ts_col="at", batch=2, inclusive=True, delivered=first, identity=["id"])
    assert rows(first, "id") == [(i,) for i in range(5)]
    assert rows(second, "id") == [(i,) for i in range(5, 10)] + [(99,)]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("batch", [None, 1, 3])
def test_rows_without_a_time_do_not_stop_polls(spark, batch, inclusive):
    """More nulls than a batch holds: all other rows still arrive once, and the nulls are given apart."""
    table = people(spark, 10).withColumn("regdt", F.when(F.col("id") > 4, F.timestamp_millis(F.col("id") * 1000)))
    options = {"inclusive": True, "identity": ["id"]} if inclusive else {}
    poller = TablePoller(fresh_dir(spark, "t"), ts_col="regdt", **({"batch": batch} if batch else {}), **options)
    assert rows(poller.run_until_empty(table), "id") == [(i,) for i in range(5, 11)]
    assert rows(untimed(table, "regdt"), "id") == [(i,) for i in range(1, 5)]
    both = TablePoller(fresh_dir(spark, "t"), ts_col="regdt", id_col="id", **({"batch": batch} if batch else {}))
    assert rows(both.run_until_empty(table), "id") == [(i,) for i in range(5, 11)]


def test_several_tables_are_polled_side_by_side(spark):
    names = ["a", "b", "c"]
    pollers = {n: TablePoller(fresh_dir(spark, "t"), id_col="id") for n in names}
    lost = []

    def table(name, n):
        if name == "b" and not lost:
            lost.append(name)
            raise ConnectionError("gone")
        return people(spark, n)

    first = poll_tables(pollers, {n: lambda n=n: table(n, 4) for n in names})
    assert first["a"] == first["c"] == 1 and isinstance(first["b"], ConnectionError)
    assert poll_tables(pollers, {n: lambda n=n: table(n, 7) for n in names}) == {"a": 2, "b": 1, "c": 2}
    for name in names:
        assert rows(spark.read.parquet(f"{pollers[name].path}/data"), "id") == [(i,) for i in range(1, 8)]
    assert poll_tables({}, {}) == {}
