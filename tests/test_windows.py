"""Skew-safe window helpers against brute force, on data with one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wholesail.operators.sampling import exact_n, ranked
from wholesail.operators.stats import exact_quantiles
from wholesail.operators.windows import cumulative_at, global_rank, running_sum, running_sums

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 20)}"
        t = 1_600_000_000_000_000 + rnd.randint(0, 40) * DAY + rnd.randint(0, DAY - 1)
        rows.append((f"e{i:04d}", key, t, float(rnd.randint(-500, 500)) / 4))
    df = spark.createDataFrame(rows, "id string, key string, t long, v double").withColumn(
        "ts", F.timestamp_micros("t"))
    return df, rows


def test_running_sum_equals_plain_window(spark, events):
    df, _ = events
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    got = {r["id"]: r["running_sum"] for r in running_sum(df, "key", ["ts", "id"], "v").collect()}
    assert got == pytest.approx(want)


def test_trailing_count_brute_force(spark, events):
    df, rows = events
    W = 3 * DAY
    got = cumulative_at(df, df, "key", "ts", F.col("t"), "id").select("id", "_cnt")
    lo = cumulative_at(df, df, "key", "ts", F.col("t") - W - 1, "id").select("id", F.col("_cnt").alias("lo"))
    res = {r["id"]: r["_cnt"] - r["lo"] for r in got.join(lo, "id").collect()}
    for i, k, t, _ in rows:
        want = sum(1 for _, k2, t2, _ in rows if k2 == k and t - W <= t2 <= t)
        assert res[i] == want


def test_exact_quantiles_match_numpy(spark, events):
    df, rows = events
    probs = [0.1, 0.25, 0.5, 0.9, 0.99]
    got = exact_quantiles(df, "v", probs, ranges=8).first()["breaks"]
    assert got == pytest.approx(list(np.percentile([r[3] for r in rows], [p * 100 for p in probs])))


def test_global_rank_is_a_total_order(spark, events):
    df, rows = events
    got = {r["id"]: r["rank"] for r in global_rank(df, "v", "id", ranges=8).collect()}
    want = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, len(rows) + 1))


def test_hash_rank_within_groups(spark, events):
    df, _ = events
    r = ranked(df, "id", 42, ["key"])
    w = Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit("42|"), "id")), "id")
    plain = df.withColumn("rn", F.row_number().over(w))
    j = r.join(plain.select("id", "rn"), "id")
    assert j.filter(F.col("_rank") != F.col("rn")).count() == 0


def test_null_keys_keep_their_running_state(spark):
    rows = [(None, 0, 10.0), (None, 1, 5.0), ("a", 0, 1.0), ("a", 3, 2.0)]
    df = spark.createDataFrame(rows, "key string, day int, v double").withColumn("ts", F.timestamp_micros(F.col("day") * DAY))
    want = [(None, 0, 10.0), (None, 1, 15.0), ("a", 0, 1.0), ("a", 3, 3.0)]
    one = running_sum(df, "key", ["ts"], "v").select("key", "day", "running_sum")
    many = running_sums(df, "key", ["ts"], {"s": "v"}).select("key", "day", "s")
    for out in (one, many):
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    probes = df.withColumn("t", F.unix_micros("ts"))
    got = {(r["day"], r["key"]): r["_cnt"] for r in probes.join(cumulative_at(
        df, probes.withColumn("pid", F.struct("key", "day")), "key", "ts", F.col("t"), "pid").select("pid", "_cnt"),
        F.struct("key", "day").eqNullSafe(F.col("pid"))).collect()}
    assert got == {(0, None): 1, (1, None): 2, (0, "a"): 1, (3, "a"): 2}


def test_ranked_keeps_null_groups_and_null_keys(spark):
    rows = [(f"o{i}" if i % 7 else None, None if i % 4 == 0 else "web") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, channel string")
    out = ranked(df, "id", 1, ["channel"]).collect()
    assert len(out) == 20
    for c in (None, "web"):
        assert sorted(r["_rank"] for r in out if r["channel"] == c) == list(range(1, 1 + sum(r[1] == c for r in rows)))


@pytest.mark.parametrize("n", [0, 1, 7, 599, 600, 1000])
def test_exact_n_takes_the_first_by_hash(spark, events, n):
    df, rows = events
    want = {r["id"] for r in ranked(df, "id", 5).filter(F.col("_rank") <= n).collect()}
    got = [r["id"] for r in exact_n(df, n, "id", 5).collect()]
    assert len(got) == min(n, len(rows)) and set(got) == want
