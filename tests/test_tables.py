"""Aggregates, dedup, compaction, rekeying and audits."""

import glob
import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import audit, dedup, rekey
from tidemark.sinks.compact import StoredLog
from tidemark.sources import generate, topic
from tidemark.sources.tables import chosen_tables, jdbc_options


def test_null_keys_stay_in_the_stream_and_leave_the_table(spark):
    s = spark.createDataFrame([(0, 1, 1), (1, 2, None), (2, None, 3)], "o bigint, key int, value int")
    assert s.count() == 3
    assert rows(agg.latest_by_offset(s, ["key"], ["value"], "o")) == [(1, 1), (2, None)]


def test_latest_and_earliest_skip_nulls_unless_asked(spark):
    s = spark.createDataFrame([(0, 1, None), (1, 1, 5), (2, 1, 6), (3, 1, None)], "o bigint, k int, v int")
    assert rows(agg.latest_by_offset(s, ["k"], ["v"], "o")) == [(1, 6)]
    assert rows(agg.earliest_by_offset(s, ["k"], ["v"], "o")) == [(1, 5)]
    assert rows(agg.latest_by_offset(s, ["k"], ["v"], "o", ignore_nulls=False)) == [(1, None)]
    assert rows(agg.earliest_by_offset(s, ["k"], ["v"], "o", ignore_nulls=False)) == [(1, None)]


def test_window_counts_add_up_to_the_messages(spark):
    s = generate.with_person(spark.range(1, 41), "id").withColumns(
        {"k": F.concat_ws("-", F.lit("1"), "id"), "ts": F.timestamp_seconds(F.col("id") * 7)})
    counts = agg.tumbling_count(s, ["k"], "ts", "1 minute", "id")
    assert counts.agg(F.sum("n")).first()[0] == 40


def test_dedup_removes_repeats_inside_a_window_only(spark):
    people = generate.with_person(spark.range(1, 101), "id").withColumn("ts", F.timestamp_seconds(F.col("id") % 40))
    sent = generate.inject_anomalies(people, "id", "ts", dup_rate=0.2, dup_delay="3 seconds")
    assert sent.count() > 100
    log = sent.withColumn("place", F.struct("emit_ts", "delivery"))
    kept = dedup.dedup_windowed(log, ["id", "name"], "emit_ts", "1 minute", "place")
    assert kept.count() == 100 and kept.where("delivery = 'duplicate'").count() == 0
    again = dedup.dedup_windowed(kept.drop("copies"), ["id", "name"], "emit_ts", "1 minute", "place")
    assert rows(again.drop("copies").select("id")) == rows(kept.select("id"))
    late = generate.inject_anomalies(people, "id", "ts", dup_rate=1.0, dup_delay="2 minutes")
    late = late.withColumn("place", F.struct("emit_ts", "delivery"))
    assert dedup.dedup_windowed(late, ["id", "name"], "emit_ts", "1 minute", "place").count() == 200


def test_anomalies_lose_nothing_and_resend_the_stored_row(spark):
    people = generate.with_person(spark.range(1, 501), "id").withColumn("ts", F.timestamp_seconds("id"))
    sent = generate.inject_anomalies(people, "id", "ts", dup_rate=0.2, lag_rate=0.1)
    n = {r.delivery: r["count"] for r in sent.groupBy("delivery").count().collect()}
    assert n["normal"] + n["late"] == 500 and 50 < n["duplicate"] < 150 and 20 < n["late"] < 90
    assert sent.select("id", "name").distinct().count() == 500


def compaction_log(spark):
    data = [("Bob", "100"), ("Lucy", "100"), ("Bob", "200"), ("Lucy", "200"), ("Patric", "200"), ("Patric", "300")]
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "offset bigint, key string, value string")


def test_compaction(spark):
    log = compaction_log(spark)
    last = [("Bob", "200"), ("Lucy", "200"), ("Patric", "300")]
    assert rows(dedup.compact_log(log), "key", "value") == last
    head = dedup.compact_log(log, closed_upto=5)
    assert rows(head, "key", "value") == [*last[:2], ("Patric", "200"), ("Patric", "300")]


def test_tombstones_delete_keys_but_null_fields_do_not(spark):
    log = compaction_log(spark).unionByName(
        spark.createDataFrame([(6, "Bob", None), (7, "Lucy", '{"a":null}'), (8, None, "x")],
                              "offset bigint, key string, value string"))
    assert rows(dedup.compact_log(log), "key", "value") == [("Lucy", '{"a":null}'), ("Patric", "300")]
    assert ("Bob", None) in rows(dedup.compact_log(log, drop_tombstones=False), "key", "value")


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_repartition_keeps_order_per_key(spark, size):
    data = [(k, v) for v in "123" for k in "abcd"]
    log = spark.createDataFrame([(0, i, *d) for i, d in enumerate(data)],
                                "partition int, offset bigint, key string, value string")
    moved = rekey.repartition_topic(log, 2, hot_rows=1, segment_rows=size)
    got = rows(moved, "partition", "offset", "key", "value")
    assert [g for g in got if g[0] == 1] == [(1, i, "d", str(i + 1)) for i in range(3)]
    assert [g[1:] for g in got if g[0] == 0] == [(i, k, v) for i, (k, v) in enumerate(
        d for d in data if d[0] != "d")]
    places = rekey.key_positions(moved, hot_rows=1, segment_rows=size)
    assert all(v == str(p) for v, p in rows(places, "value", "position"))


def test_repartition_of_several_topics_and_partitions_is_repeatable(spark):
    log = spark.createDataFrame(
        [(t, p, o, f"k{(p + o) % 5}" if o % 3 else None, f"{t}{p}{o}") for t in "ab" for p in range(4) for o in range(20)],
        "topic string, partition int, offset long, key string, value string")
    one, two = (rows(rekey.repartition_topic(d, 3)) for d in (log, log.orderBy(F.desc("value")).repartition(5)))
    assert one == two and len({r[:3] for r in one}) == 160
    for size in (1, 10**9):
        assert rows(rekey.repartition_topic(log, 3, hot_rows=size, segment_rows=7)) == one
    places = rows(rekey.key_positions(rekey.repartition_topic(log, 3)), "topic", "partition", "key", "position")
    assert len(set(places)) == 160


def test_repartition_deals_out_messages_without_key(spark):
    log = spark.range(10).select(F.lit(0).alias("partition"), F.col("id").alias("offset"),
                                 F.lit(None).cast("string").alias("key"), F.lit("v").alias("value"))
    got = rows(rekey.repartition_topic(log, 2), "partition", "offset")
    assert got == [(p, o) for p in (0, 1) for o in range(5)]


def test_missing_ids(spark):
    seen = spark.createDataFrame([(1,), (2,), (2,), (5,)], "id bigint")
    assert rows(audit.missing_ids(seen, "id", 1, 6)) == [(3,), (4,), (6,)]


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 5, "segment_rows": 3}])
def test_gaps_of_sparse_and_huge_ids(spark, limits):
    top = 10**15
    present = [3, 4, 4, 7, 10, top - 2, top, None, -5, top + 9]
    seen = spark.createDataFrame([(i,) for i in present], "id bigint").repartition(3)
    got = rows(audit.id_gaps(seen, "id", 1, top, **limits))
    assert got == [(1, 2, 2), (5, 6, 2), (8, 9, 2), (11, top - 3, top - 13), (top - 1, top - 1, 1)]
    assert rows(audit.id_gaps(seen.limit(0), "id", 1, 9, **limits)) == [(1, 9, 9)]
    assert rows(audit.id_gaps(seen, "id", 3, 4, **limits)) == []


def test_missing_ids_near_the_top_of_a_wide_range(spark, monkeypatch):
    monkeypatch.setattr(audit, "PIECE", 7)
    top = 10**15
    seen = spark.range(top - 15_000, top).where("id % 3 > 0")
    begin = time.monotonic()
    got = audit.missing_ids(seen, "id", top - 15_040, top - 1)
    assert got.count() == 40 + 5000 and got.agg(F.min("id"), F.max("id")).first() == (top - 15_040, top - 1)
    assert time.monotonic() - begin < 30


def log_rows(spark, keys, low=0, topic="t", partition=0):
    data = [(topic, partition, low + i, k, v) for i, (k, v) in enumerate(keys)]
    return spark.createDataFrame(data, "topic string, partition int, offset bigint, key string, value string").withColumn(
        "timestamp", F.timestamp_seconds("offset"))


def test_a_stored_log_is_compacted_where_it_pays(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/stored")
    log.append(log_rows(spark, [("a", "1"), ("b", "1"), ("a", "2"), ("a", None), (None, "x"), ("b", "2"), ("c", "1"), ("b", "3")]))
    log.append(log_rows(spark, [(str(k), "v") for k in range(8)], topic="fresh", partition=1))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/stored/log/**/*.parquet", recursive=True)}
    earlier = log.read()  # a reader that began before the compaction
    whole = rows(earlier.select("topic", "offset", "key", "value"))
    assert log.compact(head=2) == [("t", 0)]
    assert rows(earlier.select("topic", "offset", "key", "value")) == whole
    assert {p: os.stat(p).st_mtime_ns for p in before} == before
    kept = rows(log.read().where("topic = 't'"), "offset", "key", "value")
    assert kept == [(5, "b", "2"), (6, "c", "1"), (7, "b", "3")]  # the tombstone took a with it, and the head is as it was
    assert log.read().where("topic = 'fresh'").count() == 8
    assert log.compact(head=2) == []
    log.append(log_rows(spark, [("b", str(k)) for k in range(4, 9)], low=8))
    assert rows(log.read().where("topic = 't'"), "offset") == [(k,) for k in range(5, 13)]
    assert log.compact(head=1, limit=0.8) == [] and log.compact(head=1) == [("t", 0)]
    assert rows(log.read().where("topic = 't'"), "offset", "key", "value") == [(6, "c", "1"), (11, "b", "7"), (12, "b", "8")]
    assert len(log.pointer()) == 1


def test_a_compaction_that_fails_before_its_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    log = StoredLog(spark, f"{tmp_path}/stored")
    log.append(log_rows(spark, [("a", str(k)) for k in range(6)]))
    whole = rows(log.read(), "offset", "value")
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.compact(head=0)
    monkeypatch.undo()
    assert rows(log.read(), "offset", "value") == whole
    assert log.compact(head=0) == [("t", 0)]
    assert rows(log.read(), "offset", "value") == [(5, "5")]


def test_duplicates_of_one_id_that_fills_the_log(spark):
    log = spark.range(500).select(
        F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("id"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), F.col("id").alias("offset"))
    report = audit.duplicate_report(log, "id", ["topic", "partition", "offset"])
    assert rows(report, "id", "offset", "n") == [(7, i, 400) for i in range(400)]
    assert rows(audit.duplicate_rate(log, "id")) == [(500, 399, 79.8)]
    assert audit.duplicate_rate(log.limit(0), "id").first().percent is None


def test_reconcile(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "k int")
    assert rows(audit.reconcile_counts(a, b, ["k"]), "k", "source_n", "sink_n", "status") == [
        (1, 1, 1, "ok"), (2, 2, 1, "missing"), (3, 1, 2, "duplicate"), (4, 0, 1, "duplicate")]


def test_wait_until_stable():
    counts = iter([1, 2, 3, 3, 3, 3, 9])
    assert audit.wait_until_stable(lambda: next(counts), equal_reads=3, pause=0) == 3
    grow = iter(range(100))
    with pytest.raises(TimeoutError):
        audit.wait_until_stable(lambda: next(grow), pause=0, max_reads=20)


def test_topk_and_sample(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("pid"), F.col("id").alias("sid"))
    assert rows(agg.top_rows(df, [F.asc("pid"), F.desc("sid")], 2)) == [(0, 96), (0, 99)]
    one, two = (rows(agg.sample_rows(d, ["sid"], 10, seed=3)) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 10
    assert one != rows(agg.sample_rows(df, ["sid"], 10, seed=4))


def test_throughput(spark):
    df = spark.range(11).select(F.lit("t").alias("topic"), F.timestamp_seconds("id").alias("ts"))
    assert rows(agg.throughput(df, ["topic"], "ts")) == [("t", 11, 10.0, 1.1)]


def test_offsets(spark):
    log = spark.createDataFrame([("a", 0, 3), ("a", 0, 4), ("a", 1, 0), ("b", 0, 9)], "topic string, partition int, offset bigint")
    marks = topic.next_offsets(log)
    assert marks == {"a": {0: 5, 1: 1}, "b": {0: 10}}
    assert rows(log.where(topic.not_before({"a": {0: 4}}))) == [("a", 0, 4), ("a", 1, 0), ("b", 0, 9)]
    assert log.where(topic.not_before(marks)).count() == 0 and log.where(topic.not_before({})).count() == 4
    assert rows(topic.offset_spans(log)) == rows(topic.message_counts(log)) == [("a", 3), ("b", 1)]


def test_broker_and_database_options():
    opts = topic.broker_options("h:1", ["a", "b"], {"a": {0: 5}})
    assert opts["subscribe"] == "a,b" and opts["startingOffsets"] == '{"a": {"0": 5}}'
    opts = jdbc_options("jdbc:x", split_on="id", bounds=(1, 100), slices=4, session_sql="SET X")
    assert opts["numPartitions"] == "4" and opts["sessionInitStatement"] == "SET X"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", split_on="id")
    assert chosen_tables(["a", "b", "c"], skip=["b"]) == ["a", "c"]
    assert chosen_tables(["a", "b"], only=["b"]) == ["b"]


def test_declared_columns(spark):
    log = spark.createDataFrame([(0, '{"id": 7, "name": "x", "more": 1}')], "offset bigint, value string")
    got = topic.decode(log, "id string, name string, ip string")
    assert got.columns == ["offset", "id", "name", "ip"] and rows(got) == [(0, "7", "x", None)]
