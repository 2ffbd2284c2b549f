"""Sources and sinks: table write/read, missing-table tolerance, directory load, keyed load,
size-budget sampling, lenient vs strict casts, and log append idempotency."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wholesail.operators.sampling import size_budget_sample
from wholesail.sources.eventlog import ENVELOPE, append_events, read_events
from wholesail.sources.tables import best_source, bulk_keyed_load, load_dir, read_table, write_table


def test_write_read_load_dir(spark):
    d = tempfile.mkdtemp(prefix="wholesail-test-io-", dir="/tmp")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert write_table(df, f"{d}/a.parquet") == 10
    assert write_table(df.limit(3), f"{d}/b.parquet") == 3
    tabs = load_dir(spark, d)
    assert sorted(tabs) == ["a", "b"] and tabs["b"].count() == 3
    empty = read_table(spark, f"{d}/missing.parquet", df.schema)
    assert empty.count() == 0 and empty.schema == df.schema
    with pytest.raises(FileNotFoundError):
        read_table(spark, f"{d}/missing.parquet")
    assert best_source(spark, "a", d, "/nowhere") == f"{d}/a.parquet"
    assert best_source(spark, "zz", d, "/sample") == "/sample/zz.parquet"


def test_bulk_keyed_load(spark):
    d = tempfile.mkdtemp(prefix="wholesail-test-kl-", dir="/tmp")
    df = spark.createDataFrame([("k2", 1), ("k1", 2), ("k2", 3), ("k3", 4)], "k string, v int")
    assert bulk_keyed_load(df, f"{d}/t", "k", "v") == 3
    assert sorted(map(tuple, spark.read.parquet(f"{d}/t").collect())) == [("k1", 2), ("k2", 3), ("k3", 4)]  # the last put of k2
    assert bulk_keyed_load(df, f"{d}/u", "k", "v", limit=2) == 2
    assert sorted(r[0] for r in spark.read.parquet(f"{d}/u").collect()) == ["k1", "k2"]
    puts = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), (None, 9, "n")], "k string, v int, w string")
    for n in (1, 4):  # ties by the other columns, whatever the partitions
        assert bulk_keyed_load(puts.repartition(n), f"{d}/v{n}", "k", ["v"]) == 1
        assert [tuple(r) for r in spark.read.parquet(f"{d}/v{n}").collect()] == [("a", 1, "y")]


def test_size_budget_sample(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    out = size_budget_sample(df, 200_000, "k", 42)
    n = out.count()
    assert 0 < n < 20000


def test_lenient_and_strict_cast(spark):
    df = spark.createDataFrame([("1.5",), ("oops",), (None,)], "s string")
    assert [r[0] for r in df.select(F.col("s").try_cast("double")).collect()] == [1.5, None, None]
    with pytest.raises(Exception):
        df.select(F.col("s").cast("double")).collect()  # ANSI: a malformed value fails the job


def test_append_events_first_write_wins(spark):
    import datetime as dt

    d = tempfile.mkdtemp(prefix="wholesail-test-log-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("e1", "OrderShipped", "ORD-1", t, '{"order_id":"ORD-1"}', None, None),
                               ("e1", "OrderShipped", "ORD-1", t, '{"order_id":"DUP"}', None, None),
                               ("e2", "OrderDelivered", "ORD-1", t, '{"order_id":"ORD-1"}', None, None)], ENVELOPE)
    append_events(spark, a, f"{d}/log")
    append_events(spark, a, f"{d}/log")   # replay: nothing new
    log = spark.read.parquet(f"{d}/log")
    assert log.count() == 2
    assert read_events(log, "OrderShipped").count() == 1
    assert os.path.isdir(f"{d}/log/event_type=OrderShipped")


def test_strict_payloads(spark):
    import datetime as dt

    from wholesail.sources.eventlog import malformed_events, typed

    t = dt.datetime(2024, 1, 1)
    rows = [(f"e{i}", "InvoiceCreated", "INV-1", t, p, None, None) for i, p in enumerate(
        ['{"invoice_id":"a","amount":12.5}', '{"invoice_id":"b","amount":"12x"}', '{"invoice_id":', None, '{}'])]
    log = spark.createDataFrame(rows, ENVELOPE)
    assert sorted(r["event_id"] for r in malformed_events(log, "InvoiceCreated").collect()) == ["e1", "e2", "e3"]
    assert malformed_events(log, "PaymentCaptured").count() == 0
    got = {r["event_id"]: r["amount"] for r in typed(log, "InvoiceCreated", ["invoice_id", "amount"]).collect()}
    assert got == {"e0": 12.5, "e1": None, "e2": None, "e3": None, "e4": None}
    assert typed(log.filter("event_id in ('e0', 'e4')"), "InvoiceCreated", strict=True).count() == 2
    with pytest.raises(Exception):
        typed(log, "InvoiceCreated", ["invoice_id", "amount"], strict=True).collect()
