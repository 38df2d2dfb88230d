"""Column functions against plain implementations and fixed examples."""

import json
from datetime import datetime

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashing, jsonfn, textfn, timefn
from tidemark.plans.common import LINE_FIELDS, LINE_RECORD


def murmur(data: bytes) -> int:
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i:i + 4], "little") * m & mask
        k = (k ^ k >> 24) * m & mask
        h = h * m & mask ^ k
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=60))
def test_murmur2_matches_a_plain_implementation(spark, keys):
    keys = [k.replace("\x00", "") for k in keys if k.isprintable()] + ["", "a", "日本語", "x" * 33]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for k, h in df.select("k", hashing.murmur2(F.col("k"))).collect():
        assert h == murmur(k.encode())


def test_partition_of_known_keys(spark):
    df = spark.createDataFrame([(k,) for k in "abcd"] + [(None,)], "k string")
    got = dict(df.select("k", hashing.topic_partition(F.col("k"), 2)).collect())
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, None: None}


def test_json_concat(spark):
    cases = [
        ('{"a":1}', '{"b":{"x":[1,2]}}', {"a": 1, "b": {"x": [1, 2]}}),
        ("{}", '{"b":2}', {"b": 2}),
        ('{"a":1}', " { } ", {"a": 1}),
        ("{}", "{}", {}),
        ('{"a":{"x":1},"c":"q\\"}"}', '{"a":{"y":2}}', {"a": {"y": 2}, "c": 'q"}'}),
        ("[1]", '{"b":2}', None),
        (None, '{"b":2}', None),
        ("broken", '{"b":2}', None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    for i, merged in df.select("i", jsonfn.json_concat(F.col("a"), F.col("b"))).collect():
        assert (None if merged is None else json.loads(merged)) == cases[i][2]


LINE = (
    '2031-02-28 23:59:01,007 {"meta": {"trace": "q7", "visitor": {"number": 31, "label": "ann b"}}, '
    '"event": {"verb": "dock", "parts": [{"area": "north", "more": {"y": [2, 3]}}, {"area": "south"}]}}'
)


def test_flatten_log_line(spark):
    df = spark.createDataFrame([(LINE,), ("2031-02-28 23:59:01,007 no json",)], "line string")
    good, bad = jsonfn.flatten_log_lines(df, "line", LINE_RECORD, LINE_FIELDS).collect()
    assert (good.stamp, good.trace, good.verb) == ("2031-02-28 23:59:01,007", "q7", "dock")
    assert good.visitor == {"number": "31", "label": "ann b"}
    assert good.part["area"] == "north" and json.loads(good.part["more"]) == {"y": [2, 3]}
    assert bad.stamp == good.stamp and bad.verb is None and bad.part is None


def test_flatten_takes_any_record(spark):
    df = spark.createDataFrame([('12:30 {"a": {"b": [5, 6]}, "c": "x"}',)], "line string")
    got = jsonfn.flatten_log_lines(df, "line", "struct<a:struct<b:array<int>>,c:string>", {"last": "a.b[1]", "c": "c"}, "at", 6)
    assert rows(got) == [("12:30", 6, "x")]


def test_flatten_equals_field_by_field_reading(spark):
    df = spark.createDataFrame([(LINE,)], "line string")
    stamp, body = jsonfn.split_log_line(F.col("line"))
    msg = jsonfn.json_concat(F.concat(F.lit('{"stamp": "'), stamp, F.lit('"}')), body)
    one = df.select(msg.alias("m")).select(
        jsonfn.json_field(F.col("m"), "$.stamp"),
        jsonfn.json_field(F.col("m"), "$.meta.trace"),
        jsonfn.json_records(jsonfn.json_field(F.col("m"), "$.meta.visitor")),
        jsonfn.json_field(F.col("m"), "$.event.verb"),
        jsonfn.json_records(jsonfn.json_field(jsonfn.json_field(F.col("m"), "$.event.parts"), "$[0]")),
    ).first()
    assert tuple(one) == tuple(jsonfn.flatten_log_lines(df, "line", LINE_RECORD, LINE_FIELDS).first())


def test_payload_fields_skip_absent_ones(spark):
    df = spark.createDataFrame([('{"payload":{"id":1,"name":"x"}}',), ('{"other":1}',)], "value string")
    got = [r[0] for r in df.select(jsonfn.payload_fields(F.col("value"), ["id", "zip"])).collect()]
    assert got == [{"id": "1"}, None]
    assert jsonfn.known_columns(df, ["zip", "value"]).columns == ["value"]


def test_time_macro():
    now = datetime(2022, 8, 11, 0, 0, 1)
    assert timefn.render_macro("person_{{ MinAddFmt -1 ddHHmm }}", now) == "person_102359"
    assert timefn.render_macro("p_{{MinAddFmt 0 yyyyMMdd}} x", now) == "p_20220811 x"


def test_shifted_label_is_the_macro_as_a_column(spark):
    df = spark.sql("select timestamp '2022-08-11 00:00:01' as ts")
    assert df.select(timefn.shifted_label(F.col("ts"), -1, "ddHHmm")).first()[0] == "102359"


def test_day_range(spark):
    days = spark.range(1).select(timefn.day_range("2022-08-30", "2022-09-02")).first()[0]
    assert [str(d) for d in days] == ["2022-08-30", "2022-08-31", "2022-09-01", "2022-09-02"]


def test_rates(spark):
    lines = ["Inserter 1 inserts. 120 rows per seconds.", "Selector 2 selects. 80 rows per seconds.",
             "Inserter epoch: 3", "producer 1. 99 rows per seconds."]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert rows(textfn.rates(df, "line"), "kind", "rate") == [("ins", 120), ("sels", 80)]
