"""What queries store and move: only the events they read, and their rows as few times as the job needs."""

import datetime as dt
import glob
import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from test_bounded_walk import plain
from test_decoded_orders import odd_source
from test_logstore import small_source, stored_types
from wholesail.operators import graphs as G
from wholesail.operators import inventory as INV
from wholesail.operators.sequential import bounded_walk
from wholesail.plans import catalog
from wholesail.plans.registry import QUERIES
from wholesail.sources import adapter, logstore
from wholesail.sources.eventlog import HEAD_FIELDS, typed
from wholesail.sources.tables import Tables
from wholesail.streaming import metrics


def built(spark, tmp_path, name):
    """The query's result on a source of which nothing is stored yet, and that source."""
    catalog.load()
    d = small_source(tmp_path)
    return QUERIES[name](spark, d), d


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- stock_allocation --------------------------------------------------------------------------------
def allocation_rows(spark, n=300):
    rng = random.Random(3)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    skus = ["hot", "hot", "hot", "a", "b", None]
    rec = [(rng.choice(skus), at(rng.randint(0, 90)), f"p{i}", rng.choice([30, 50, None])) for i in range(30)]
    dem = [(rng.choice(skus), at(rng.randint(0, 99)), f"d{i}", rng.randint(1, 14)) for i in range(n)]
    schema = "sku_id string, timestamp timestamp, ref string, quantity long"
    return rec, dem, spark.createDataFrame(rec, schema), spark.createDataFrame(dem, schema)


def test_allocation_stores_only_events_it_reads(spark, tmp_path):
    df, d = built(spark, tmp_path, "stock_allocation")
    assert df.count() == 6200 and stored_types(spark, d) == {"PurchaseOrderCreated", "StockReceived"}


def test_allocation_moves_its_rows_once(spark):
    _, _, rec, dem = allocation_rows(spark)
    shown = plan(INV.allocate(rec, dem))
    assert shown.count("Exchange hashpartitioning(") == 1 and "Window" not in shown


def test_allocation_of_whole_keys_and_chunks(spark):
    rec, dem, r, d = allocation_rows(spark)
    rows = [(s, t, i, False, q or 0, None) for i, (s, t, _, q) in enumerate(rec)] + [(s, t, 1000 + i, True, q, None) for i, (s, t, _, q) in enumerate(dem)]
    refs = {i: x[2] for i, x in [*enumerate(rec), *((1000 + i, x) for i, x in enumerate(dem))]}
    # at one instant receipts come first, then by ref, as allocate orders them
    number = {ref: n for n, (_, ref) in enumerate(sorted((i >= 1000, ref) for i, ref in refs.items()))}
    want = plain([(s, t, number[refs[i]], take, q, None) for s, t, i, take, q, _ in rows], {})
    for chunk in (60, 50_000):  # 60: the hot key is walked in chunks, the others whole
        got = INV.allocate(r, d, chunk=chunk).collect()
        own = sorted(((x["sku_id"], x["timestamp"], number[x["ref"]], x["reserved"], x["available_before"], x["level_after"]) for x in got), key=repr)
        assert own == want


def test_walk_of_rows_that_name_take_and_amount(spark):
    rows = spark.createDataFrame([("x", i, i % 3, 4 if i % 3 else 5) for i in range(40)], "key string, n long, k int, q long").selectExpr("*", "timestamp_seconds(n) ts")
    one = bounded_walk(rows.selectExpr("*", "k > 0 take", "q amount"), "key", ["ts"])
    two = bounded_walk(rows, "key", ["ts"], take=F.col("k") > 0, amount=F.col("q"))
    few = bounded_walk(rows, "key", ["ts"], chunk=7, take=F.col("k") > 0, amount=F.col("q"))
    of = lambda df: sorted(tuple(r) for r in df.select("n", "accepted", "room_before", "room_after").collect())
    assert str(of(one)) == str(of(two)) == str(of(few))


# --- daily_inventory ---------------------------------------------------------------------------------
def test_days_store_only_events_they_read(spark, tmp_path):
    df, d = built(spark, tmp_path, "daily_inventory")
    assert df.count() == 200 * 50
    assert stored_types(spark, d) <= {"PurchaseOrderCreated", "StockReceived", "StockReserved", "StockReleased", "StockoutOccurred"}


def test_skus_are_moved_before_they_are_multiplied_by_days(spark):
    iv = spark.createDataFrame([("a", dt.date(2024, 1, 2), 5, 2, 3)], "sku_id string, valid_from date, on_hand long, reserved long, available long")
    asked = spark.createDataFrame([("a",)], "sku_id string").withColumn("day", F.expr("sequence(date'2024-01-01', date'2024-01-03', interval 1 day)"))
    shown = plan(INV.stock_on_days(iv, asked, spark.createDataFrame([], "sku_id string, timestamp timestamp")))
    assert shown.index("Generate explode") < shown.index("Window") and "Join" not in shown  # the plan's end is its first line
    assert shown.count("Exchange hashpartitioning(") == 3  # asked, stockouts, all by SKU


def test_days_missing_and_asked_twice(spark):
    """A missing day lies before all others; days asked twice, in one array or in several rows, are answered twice."""
    day = lambda n: n and dt.date(2024, 1, n)
    iv = spark.createDataFrame([("a", day(None), 1, 0, 1), ("a", day(5), 7, 2, 5), (None, day(3), 9, 0, 9)],
                               "sku_id string, valid_from date, on_hand long, reserved long, available long")
    outs = [("a", dt.datetime(2024, 1, 6, 3)), ("a", dt.datetime(2024, 1, 6, 9)), ("a", None), (None, dt.datetime(2024, 1, 2))]
    asked = [("a", [day(None), day(4), day(5), day(6), day(6)]), ("a", [day(7)]), (None, [day(2), day(3)]), ("new", [day(1)]), ("b", []), ("c", None)]
    s = spark.createDataFrame(outs, "sku_id string, timestamp timestamp")
    many = spark.createDataFrame(asked, "sku_id string, day array<date>")
    single = spark.createDataFrame([(k, x) for k, xs in asked for x in xs or []], "sku_id string, day date")
    want = [("a", None, 1, 0, 1, 1, True), ("a", day(4), 1, 0, 1, 0, False), ("a", day(5), 7, 2, 5, 0, False), ("a", day(6), 7, 2, 5, 2, True),
            ("a", day(6), 7, 2, 5, 2, True), ("a", day(7), 7, 2, 5, 0, False), (None, day(2), 0, 0, 0, 1, True), (None, day(3), 9, 0, 9, 0, False), ("new", day(1), 0, 0, 0, 0, False)]
    for a in (many, single):
        assert sorted((tuple(r) for r in INV.stock_on_days(iv, a, s).collect()), key=repr) == sorted(want, key=repr)


# --- causal_chains -----------------------------------------------------------------------------------
def test_chains_store_no_part_of_the_log(spark, tmp_path):
    df, d = built(spark, tmp_path, "causal_chains")
    assert df.count() == 4899 and not glob.glob(f"{logstore.log_path(spark, d)}/*")


def test_envelopes_are_those_of_the_log(spark, tmp_path):
    d = odd_source(spark, tmp_path)
    types = ["OrderCreated", "OrderDelivered", "PaymentCaptured", "StockReceived", "StockReserved"]
    log = adapter.event_log(Tables(spark, d), None, adapter.parts_of(types))
    want = sorted(map(str, log.filter(F.col("event_type").isin(types)).drop("payload").collect()))
    of = lambda: sorted(map(str, logstore.stored_envelopes(spark, d, types).collect()))
    assert of() == want and len(want) > 8
    logstore.stored_log(spark, d, ["StockReserved", "OrderDelivered"])  # some parts stored, the others derived
    assert of() == want and stored_types(spark, d) <= {"StockReserved", "StockReleased", "StockoutOccurred", "OrderDelivered", "OrderShipped", "OrderReturned", "OrderCancelled"}


def test_settled_events_are_not_written_again(spark, monkeypatch):
    sizes, whole = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: (sizes.append(self.count()), whole(self, eager))[1])
    rows = [("r", None), *((f"a{i}", "r") for i in range(20)), ("b", "a1"), ("c", "b"), ("lost", "gone")]
    got = G.causal_chains(spark.createDataFrame(rows, "event_id string, causation_id string"))
    assert got.count() == 24 and sizes == [24, 22, 2]


# --- stream_order_windows ----------------------------------------------------------------------------
def test_order_windows_store_no_part_of_the_log(spark, tmp_path):
    df, d = built(spark, tmp_path, "stream_order_windows")
    assert df.count() > 4000 and not glob.glob(f"{logstore.log_path(spark, d)}*")


def test_order_heads_are_the_orders(spark, tmp_path):
    d = odd_source(spark, tmp_path)
    log = adapter.event_log(Tables(spark, d), None, ["orders"])
    want = sorted(map(str, typed(log, "OrderCreated", HEAD_FIELDS).select("event_id", "timestamp", *HEAD_FIELDS).collect()))
    of = lambda: sorted(map(str, logstore.stored_order_heads(spark, d).collect()))
    assert of() == want and len(want) == 5
    logstore.stored_log(spark, d, ["OrderCreated"], decoded=True)
    assert of() == want


def test_windows_do_not_depend_on_the_slices(spark, monkeypatch, tmp_path):
    """A table of more rows is more slices, not larger ones: no batch, and so no state, holds more than a part of it."""
    rows = spark.range(1000).selectExpr("concat('C', id % 7) customer_id", "timestamp_seconds(id * 3000) ts", "id % 90 + 0.5D value")
    got = []
    for most in (None, 100):
        base = f"{tmp_path}/{most}"
        per = metrics.write_time_sliced(rows, f"{base}/src", "ts", files=2, most_rows=most)
        q = metrics.run_window_stream(spark, f"{base}/src", rows.schema, f"{base}/out", f"{base}/ck", watermark="1 day", width="24 hours",
                                      slide="6 hours", by=("customer_id",), files_per_trigger=per)
        got.append((max(p["numInputRows"] for p in q.recentProgress), sorted(map(str, spark.read.parquet(f"{base}/out").collect()))))
    assert got[0][0] >= 500 and got[1][0] <= 150 and got[0][1] == got[1][1] and len(got[0][1]) > 500
