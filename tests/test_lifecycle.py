"""Lifecycle transitions (batch and stream) on a hand-made timeline."""

import datetime as dt
import tempfile

from wholesail.operators.lifecycle import lifecycle_transitions
from wholesail.streaming import lifecycle as SL
from wholesail.streaming.metrics import write_time_sliced

T0 = dt.datetime(2020, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


ORDERS = [("a", day(10), "rep"), ("a", day(80), "app"), ("a", day(500), "app"), ("a", day(900), "app"),
          ("b", day(5), "direct")]
CUSTOMERS = [("a", T0), ("b", T0), ("c", T0)]


def expected():
    # a: created 0, order 10, gap to 80 = 70 → inactive@70, reactivated@80;
    #    gap 80→500 = 420 → inactive@140, dormant@230, churned@410; nothing after churn.
    # b: order 5, then silence to as_of (900) → inactive@65, dormant@155, churned@335.
    # c: never orders → counts from creation: inactive@60, dormant@150, churned@330.
    return {
        ("a", "CustomerBecameInactive", day(70)), ("a", "CustomerReactivated", day(80)),
        ("a", "CustomerBecameInactive", day(140)), ("a", "CustomerBecameDormant", day(230)),
        ("a", "CustomerChurned", day(410)),
        ("b", "CustomerBecameInactive", day(65)), ("b", "CustomerBecameDormant", day(155)),
        ("b", "CustomerChurned", day(335)),
        ("c", "CustomerBecameInactive", day(60)), ("c", "CustomerBecameDormant", day(150)),
        ("c", "CustomerChurned", day(330)),
    }


def test_batch_lifecycle(spark):
    o = spark.createDataFrame(ORDERS, "customer_id string, created_at timestamp, channel string")
    c = spark.createDataFrame(CUSTOMERS, "customer_id string, created_at timestamp")
    got = {(r[0], r[1], r[2]) for r in lifecycle_transitions(o, c).select(
        "customer_id", "event_type", "timestamp").collect()}
    assert got == expected()
    re = lifecycle_transitions(o, c).filter("event_type = 'CustomerReactivated'").first()
    assert (re["days_inactive"], re["channel"]) == (70, "app")


def test_stream_lifecycle_matches_closed_part_of_batch(spark):
    rows = [(c, t, None, "created") for c, t in CUSTOMERS] + [(c, t, ch, "order") for c, t, ch in ORDERS]
    df = spark.createDataFrame(rows, "customer_id string, ts timestamp, channel string, kind string")
    base = tempfile.mkdtemp(prefix="wholesail-test-lc-", dir="/tmp")
    write_time_sliced(df, f"{base}/src", "ts", files=3)
    SL.run_lifecycle_stream(spark, f"{base}/src", "customer_id string, ts timestamp, channel string, kind string",
                            f"{base}/out", f"{base}/ck", watermark="1 day")
    got = {(r[0], r[1], r[2]) for r in spark.read.parquet(f"{base}/out").select(
        "customer_id", "event_type", "timestamp").collect()}
    # the final watermark is day(899): every expected crossing is before it
    assert got == expected()


def test_one_state_call_walks_many_customers(spark, monkeypatch):
    """A bucket's customers are walked in one call, and come out as if each had one of its own."""
    from wholesail.streaming import buckets

    monkeypatch.setattr(SL, "bucket_of", lambda key: buckets.bucket_of(key, 2))
    customers = [(f"{c}-{i}", t) for i in range(20) for c, t in CUSTOMERS]
    rows = [(c, t, None, "created") for c, t in customers]
    rows += [(f"{c}-{i}", t, ch, "order") for i in range(20) for c, t, ch in ORDERS]
    df = spark.createDataFrame(rows, "customer_id string, ts timestamp, channel string, kind string")
    base = tempfile.mkdtemp(prefix="wholesail-test-lc-", dir="/tmp")
    per = write_time_sliced(df, f"{base}/src", "ts", files=2, per_slice=3)
    q = SL.run_lifecycle_stream(spark, f"{base}/src", "customer_id string, ts timestamp, channel string, kind string",
                                f"{base}/out", f"{base}/ck", watermark="1 day", files_per_trigger=per)
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 2
    got = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{base}/out").select("customer_id", "event_type", "timestamp").collect()]
    want = {(f"{c}-{i}", e, t) for i in range(20) for c, e, t in expected()}
    assert len(got) == len(want) and set(got) == want
