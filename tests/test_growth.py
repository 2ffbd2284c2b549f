"""Steps whose volume must not outgrow the input: noise picked row by row, tables opened on demand, running sums in one shuffle."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wholesail.operators.noise import NoiseConfig, inject_noise
from wholesail.operators.sampling import SamplerConfig, TableSpec, JoinSpec, hash_bounds, run_sampler
from wholesail.operators.windows import cumulative_at, running_sums

T0 = datetime(2000, 1, 1)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def small_log(spark, ids):
    rows = [(i, "OrderShipped", "a", T0 + timedelta(hours=n), "{}", None, None) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "event_id string, event_type string, aggregate_id string, timestamp timestamp, payload string, causation_id string, correlation_id string")


def first(ids, n, seed):
    order = sorted(set(ids), key=lambda i: ("" if i is None else hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i or ""))
    return {i for i in order[:n] if i is not None}


def test_noise_is_picked_without_a_join_of_the_log(spark):
    ids = [f"e{n % 300}" for n in range(1000)] + [None, None]
    log = small_log(spark, ids)
    cfg = NoiseConfig(out_of_order_rate=0.05, corruption_rate=0.01, late_arrival_rate=0.2)
    noisy, counts = inject_noise(log, cfg)
    assert "Join" not in plan(noisy) and "Join" not in plan(counts)
    want = [sum(i in first(ids, n, 126 + k) for i in ids) for k, n in ((1, 50), (2, 10), (3, 200))]
    got = counts.first()
    assert [got["out_of_order"], got["corrupt"], got["late"], got["rows"]] == [*want, 1002]
    late, early = first(ids, 200, 129), first(ids, 50, 127)
    moved = {i: -timedelta(days=2) * (i in late) - timedelta(hours=1) * (i in early) for i in set(ids)}
    at = sorted((T0 + timedelta(hours=n) + moved[i]).isoformat() for n, i in enumerate(ids))
    assert sorted(r["t"] for r in noisy.select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("t")).collect()) == at


def test_noise_since_a_time_picks_ids_seen_since(spark):
    ids = [f"e{n % 400}" for n in range(500)]
    since = 300  # e300.. and the repeated e0..e99
    cfg = NoiseConfig(out_of_order_rate=0.0, late_arrival_rate=0.1, since=str(T0 + timedelta(hours=since)))
    picked = first(ids[since:], 50, 129)
    assert inject_noise(small_log(spark, ids), cfg)[1].first()["late"] == sum(i in picked for i in ids)


def test_hash_bounds_at_the_ends(spark):
    df = spark.createDataFrame([(f"k{n % 7}",) for n in range(70)], "id string")
    assert hash_bounds(df, "id", {1: 0}) == {1: None}
    assert hash_bounds(df, "id", {1: 8, 2: 7}) == {1: ("g", ""), 2: max((hashlib.md5(f"2|k{n}".encode()).hexdigest(), f"k{n}") for n in range(7))}
    assert hash_bounds(df.limit(0), "id", {1: 3}) == {1: ("g", "")}


def test_sampler_opens_only_what_is_read(spark):
    opened = []

    class Tables(dict):
        def __getitem__(self, name):
            opened.append(name)
            return super().__getitem__(name)

    orders = spark.createDataFrame([(f"o{n}", T0, "web") for n in range(20)], "order_id string, created_at timestamp, channel string")
    lines = orders.select("order_id", F.lit(1).alias("q"))
    cfg = SamplerConfig(tables=[TableSpec("orders", filter="date_window", split_anchor=True), TableSpec("lines", join=JoinSpec("orders", "order_id")),
                                TableSpec("skus", static=True)], stratify_by=["channel"])
    run = run_sampler(Tables(orders=orders, lines=lines, skus=orders), cfg)
    assert run.samples["sample_a"]["orders"].count() == 10 and set(opened) == {"orders"}
    assert run.samples["sample_b"]["lines"].count() == 10 and set(opened) == {"orders", "lines"}
    assert set(run.samples["sample_a"]) == {"orders", "lines"} and set(run.reference) == {"skus"}


def test_running_sums_of_many_keys_shuffle_rows_once(spark):
    rows = spark.range(40_000).select((F.col("id") % 8_000).alias("k"), F.timestamp_seconds(F.col("id") * 50_000).alias("ts"), (F.col("id") % 11).alias("v"))
    out = running_sums(rows, "k", ["ts"], {"s": "v"})
    assert "Join" not in plan(out) and plan(out).count("Window [") + plan(out).count("Window(") <= 1
    got = out.groupBy("k").agg(F.max("s").alias("s")).filter("k = 5").first()["s"]
    assert got == sum(n % 11 for n in range(5, 40_000, 8_000))


def test_hot_and_other_keys_agree_with_plain_sums(spark):
    rows = [("hot" if n % 3 == 0 else None if n % 50 == 1 else f"k{n}" if n % 3 == 1 else f"k{n % 900}", T0 + timedelta(hours=7 * (n * 37 % 501)), n, n % 13) for n in range(6000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, v long")
    want, seen = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + v
        want[i] = seen[k]
    assert {r["id"]: r["s"] for r in running_sums(df, "k", ["ts", "id"], {"s": "v"}).collect()} == want
    upto = {i: sum(1 for x in rows if x[0] == k and x[1] <= ts) for k, ts, i, _ in rows[:300]}
    got = {r["id"]: r["_cnt"] for r in cumulative_at(df, df.filter("id < 300"), "k", "ts", F.unix_micros("ts"), "id").collect()}
    assert got == upto
