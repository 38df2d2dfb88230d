"""Stream and table joins on small hand-written streams."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.operators.skew import lookup_join


def people(spark):
    return spark.createDataFrame([(i, f"p{i}", 0) for i in range(1, 11)], "id int, name string, ms bigint").select(
        "id", "name", F.timestamp_millis("ms").alias("pts"))


def emails(spark, delay):
    data = [(i, f"old{i:02d}@email.com", 0) for i in range(2, 11, 2)]
    data += [(i, f"new{i:02d}@email.com", delay) for i in range(3, 11, 3)]
    df = spark.createDataFrame([(n, *d) for n, d in enumerate(data)], "seq bigint, id int, email string, ms bigint")
    return df.select("seq", "id", "email", F.timestamp_millis("ms").alias("ets"))


def test_within_five_seconds(spark):
    got = j.within_join(people(spark), emails(spark, 7000), ["id"], "pts", "ets", "5 seconds")
    assert rows(got, "id", "email") == [(i, f"old{i:02d}@email.com") for i in (2, 4, 6, 8, 10)]


@pytest.mark.parametrize("apart,found", [(5000, 1), (-5000, 1), (5001, 0), (-5001, 0), (0, 1)])
def test_within_bounds_are_inclusive(spark, apart, found):
    a = spark.sql("select 1 as id, timestamp_millis(1000003) as a")
    b = spark.sql(f"select 1 as id, timestamp_millis({1000003 + apart}) as b")
    assert j.within_join(a, b, ["id"], "a", "b", "5 seconds").count() == found


def test_within_equals_brute_force(spark):
    a = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"),
                                F.timestamp_millis(F.col("id") * 37 % 5000).alias("a"))
    b = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("y"),
                                F.timestamp_millis(F.col("id") * 53 % 5000 - 100).alias("b"))
    ra, rb = a.collect(), b.collect()
    want = sorted((p.x, q.y) for p in ra for q in rb
                  if p.k == q.k and abs((p.a - q.b).total_seconds()) <= 0.25)
    assert rows(j.within_join(a, b, ["k"], "a", "b", "250 milliseconds"), "x", "y") == want


def test_join_latest_value(spark):
    got = j.join_latest(people(spark), emails(spark, 0), ["id"], ["email"], "seq", ["name"])
    want = {i: "old" for i in (2, 4, 8, 10)} | {i: "new" for i in (3, 6, 9)}
    assert rows(got, "id", "email") == [(i, f"{want[i]}{i:02d}@email.com") for i in sorted(want)]


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), "id")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for how, n in (("inner", 1000), ("left", 1000)):
        assert lookup_join(big, small, ["k"], ["id"], how, hot_rows=50).count() == n
    other = lookup_join(big.withColumn("k", F.lit(3)), small, ["k"], ["id"], "left", hot_rows=50)
    assert other.where("v is null").count() == 1000


def made_arrivals(seed=11, n=60):
    """Messages of two streams in arrival order: ``(seq, side, id, text, at)``; event times are out of order."""
    rng = random.Random(seed)
    return [(k, rng.choice("pe"), rng.randrange(5), f"t{k}", rng.randrange(1000)) for k in range(n)]


def known_at_arrival(log):
    """A plain loop: each person with the last email of the id that arrived before."""
    last, out = {}, []
    for _, side, key, text, _ in log:
        if side == "e":
            last[key] = text
        else:
            out.append((key, text, last.get(key)))
    return sorted(out, key=lambda r: r[:2])


ARRIVALS = made_arrivals()
JOINED = known_at_arrival(ARRIVALS)


def arrivals(spark):
    df = spark.createDataFrame(ARRIVALS, "seq bigint, side string, id int, text string, at bigint")
    p = df.where("side = 'p'").select("seq", "id", F.col("text").alias("name"), "at")
    e = df.where("side = 'e'").select("seq", "id", F.col("text").alias("email"), "at")
    return p, e


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_left_join_sees_the_table_at_arrival(spark, size):
    p, e = arrivals(spark)
    got = j.asof_join(p, e, ["id"], ["seq"], ["email"], hot_rows=1, segment_rows=size)
    assert rows(got, "id", "name", "email") == JOINED


@pytest.mark.parametrize("ignore_nulls", [True, False])
def test_left_join_by_event_time_back_fills(spark, ignore_nulls):
    p, e = arrivals(spark)
    got = j.asof_join(p, e, ["id"], ["at", "seq"], ["email"], ignore_nulls,
                      dense=False, hot_rows=1, segment_rows=3)
    assert rows(got, "id", "name", "email") == known_at_arrival(sorted(ARRIVALS, key=lambda r: (r[4], r[0])))


def test_nulls_are_filled_with_the_first_value(spark):
    p, e = arrivals(spark)
    joined = j.asof_join(p, e, ["id"], ["seq"], ["email"])
    got = j.fill_earliest(joined, e, ["id"], ["email"], "seq", ["seq"])
    first = {key: text for _, side, key, text, _ in reversed(ARRIVALS) if side == "e"}
    assert rows(got, "id", "name", "email") == [(i, n, m or first[i]) for i, n, m in sorted(
        JOINED, key=lambda r: r[:2])]
    assert any(m is None for _, _, m in JOINED)


def test_null_keys_and_null_values(spark):
    p = spark.createDataFrame([(1, None), (3, 7), (5, 7)], "seq bigint, id int")
    e = spark.createDataFrame([(0, None, "x"), (2, 7, "y"), (4, 7, None)], "seq bigint, id int, v string")
    got = j.asof_join(p, e, ["id"], ["seq"], ["v"])
    assert rows(got, "seq", "v") == [(1, None), (3, "y"), (5, "y")]
    got = j.asof_join(p, e, ["id"], ["seq"], ["v"], ignore_nulls=False)
    assert rows(got, "seq", "v") == [(1, None), (3, "y"), (5, None)]


@pytest.mark.parametrize("hot", [1, 7, 40, 10**9])
def test_within_join_is_the_same_for_any_grid(spark, hot):
    """One busy key inside one bucket, rows equal in all columns, null keys."""
    left = spark.range(120).selectExpr("if(id < 90, 1, id % 5) as k", "timestamp_seconds(1000 + id div 4) as at", "id div 3 as l")
    right = spark.range(150).selectExpr("if(id < 100, 1, nullif(id % 4, 0)) as k", "timestamp_seconds(1000 + id div 6) as seen", "id as r")
    got = j.within_join(left, right, ["k"], "at", "seen", "5 seconds", hot_rows=hot)
    plain = left.join(right, "k").where("abs(unix_seconds(at) - unix_seconds(seen)) <= 5")
    assert got.columns == plain.columns and rows(got) == rows(plain)


def test_a_busy_bucket_is_spread_over_tasks(spark):
    left = spark.range(4000).selectExpr("1 as k", "timestamp_seconds(1000) as at", "id as l")
    right = spark.range(50).selectExpr("1 as k", "timestamp_seconds(1000) as seen", "id as r")
    got = j.within_join(left, right, ["k"], "at", "seen", "5 seconds", hot_rows=500)
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 150_000
