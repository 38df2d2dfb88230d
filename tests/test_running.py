"""Running values in segments equal plain windows, also when one key holds most rows."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import running as r
from tidemark.operators import skew


@pytest.fixture(scope="module")
def log(spark):
    # key 0 holds two thirds of the rows; times are uneven and a third of them equal
    n = F.col("id")
    return spark.range(3000).select(
        n.alias("seq"),
        F.when(n % 3 < 2, F.lit(0)).otherwise(n % 7).alias("key"),
        F.when(n % 4 == 0, n * 10).alias("value"),
        F.when(n % 3 == 0, F.lit(5000)).otherwise(n * n % 9973).alias("at"),
    ).repartition(5)


def measures(place):
    return {
        "n": r.running_count(),
        "top": r.running_max(F.col("value")),
        "last": r.running_last(F.col("value"), place),
    }


def plain(df, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "seq", F.count(F.lit(1)).over(w).alias("n"), F.max("value").over(w).alias("top"),
        F.last("value", ignorenulls=True).over(w).alias("last"))


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
@pytest.mark.parametrize("hot", [0, 500, 10**9])
@pytest.mark.parametrize("keys", [["key"], []])
def test_cut_by_position(log, size, hot, keys):
    got = r.with_running(log, keys, ["seq"], measures(F.col("seq")), hot_rows=hot, segment_rows=size)
    assert rows(got, "seq", "n", "top", "last") == rows(plain(log, keys, ["seq"]))


@pytest.mark.parametrize("size", [50, 700, 10**6])
@pytest.mark.parametrize("keys", [["key"], []])
def test_cut_by_value_with_heavy_ties(log, size, keys):
    got = r.with_running(log, keys, ["at", "seq"], measures(F.struct("at", "seq")), dense=False,
                         hot_rows=500, segment_rows=size)
    assert rows(got, "seq", "n", "top", "last") == rows(plain(log, keys, ["at", "seq"]))


def test_ranges_are_bounded_even_for_equal_values(log):
    stored = r.stored_in_order(log, ["at", "seq"], 30)
    assert stored.count() == 3000
    assert stored.groupBy(r.SEGMENT).count().agg(F.max("count")).first()[0] <= 300


@pytest.mark.parametrize("size", [1, 7, 10**9])
def test_null_keys_are_numbered_alike_at_every_size(spark, size):
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 2)
    df = spark.range(100).select(F.col("id").alias("seq"), key.alias("key"), F.lit(None).cast("int").alias("value"))
    for dense in (True, False):
        got = r.with_running(
            df, ["key"], ["seq"], {"n": r.running_count(), "last": r.running_last(F.col("value"), F.col("seq"))},
            dense=dense, hot_rows=size, segment_rows=size)
        want, have = {}, []
        for seq in range(100):
            k = seq % 2 if seq % 3 == 0 else None
            want[k] = want.get(k, 0) + 1
            have.append((seq, want[k], None))
        assert rows(got, "seq", "n", "last") == have


def test_a_hot_key_is_found_in_rows_that_take_no_space(spark, tmp_path):
    spark.range(300_000).select(F.lit(5).alias("key")).write.parquet(f"{tmp_path}/one")
    (key, n), = rows(skew.hot_keys(spark.read.parquet(f"{tmp_path}/one"), ["key"], 100_000))
    assert key == 5 and n > 200_000


def test_empty_input(spark):
    df = spark.createDataFrame([], "seq bigint, at bigint")
    assert r.with_running(df, [], ["at", "seq"], {"n": r.running_count()}, dense=False, hot_rows=0).count() == 0


def test_hot_keys_are_found_on_a_sample(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    (key, n), = rows(skew.hot_keys(df, ["key"], 40_000))
    assert key == 7 and 50_000 < n < 85_000
    assert 150_000 < skew.row_estimate(df, 40_000) < 250_000


def test_hot_keys(log, monkeypatch):
    assert rows(skew.hot_keys(log, ["key"], 400)) == [(0, 2143)]
    assert skew.hot_keys(log, ["key"], 10**6) is None
    many = rows(skew.hot_keys(log, ["key"], 1))
    assert len(many) > 1 and (0, 2143) in many
    monkeypatch.setattr(skew, "MOST_LOCAL", 1)  # more of them than that are stored
    assert rows(skew.hot_keys(log, ["key"], 1)) == many
    assert "Relation [" in skew.hot_keys(log, ["key"], 1)._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_take_one_job_and_no_forced_broadcast(spark, log):
    tracker, group = spark.sparkContext.statusTracker(), "hot-keys"
    spark.sparkContext.setJobGroup(group, group)
    hot = skew.hot_keys(log, ["key"], 400)
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # one over the rows; the counts and the limit follow on its shuffle
    plan = hot._jdf.queryExecution().optimizedPlan()
    assert "LocalRelation" in plan.toString() and int(str(plan.stats().sizeInBytes())) < 1 << 20


def test_segments_do_not_grow_with_the_log(log):
    stored = r.stored_in_order(log, ["at", "seq"], 2, segment_rows=100)
    sizes = stored.groupBy(r.SEGMENT).agg(F.count("*").alias("n"), F.min(F.struct("at", "seq")).alias("a"), F.max(F.struct("at", "seq")).alias("b"))
    got = sizes.orderBy(r.SEGMENT).collect()
    assert max(x.n for x in got) == 100 and sum(x.n for x in got) == 3000
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [10, 500, 10**9])
def test_lookup_join_equals_plain_join(spark, log, how, hot):
    small = spark.createDataFrame([(0, "zero"), (1, "one"), (99, "x")], "key bigint, text string")
    got = skew.lookup_join(log, small, ["key"], ["seq"], how, hot_rows=hot)
    assert rows(got, "seq", "text") == rows(log.join(small, "key", how), "seq", "text")
