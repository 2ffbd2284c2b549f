"""Streaming decision chain: replay is idempotent; malformed and skipped records are accounted for."""

import datetime as dt
import tempfile

import pytest

from pyspark.sql import functions as F

from wholesail.streaming import decisions as SD


def records(spark, rows):
    return spark.createDataFrame(rows, SD.CHANGE_RECORD)


def img(oid, amount="1000", fraud="0.1"):
    return (oid, "C-1", "premium", "credit", amount, fraud, "0")


def test_chain_idempotent_and_skips(spark):
    base = tempfile.mkdtemp(prefix="wholesail-test-stream-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("INSERT", "ORD-1", t, img("ORD-1")),
        ("MODIFY", "ORD-2", t + dt.timedelta(minutes=1), img("ORD-2", fraud="0.9")),
        ("REMOVE", "ORD-3", t + dt.timedelta(minutes=2), img("ORD-3")),
        ("INSERT", "ORD-4", t + dt.timedelta(minutes=3), None),
        ("INSERT", "ORD-5", t + dt.timedelta(minutes=4), img("ORD-5", amount="12,5x")),
        ("INSERT", "ORD-1", t + dt.timedelta(minutes=5), img("ORD-1")),   # duplicate delivery
    ]
    SD.write_change_records(records(spark, rows), f"{base}/src", files=2)
    SD.run_decisions(spark, f"{base}/src", f"{base}/out", f"{base}/ck1")
    read = lambda t: spark.read.parquet(f"{base}/out/{t}")
    assert sorted(r[0] for r in read("actions").select("order_id").collect()) == ["ORD-1", "ORD-2"]
    assert [r[0] for r in read("quarantine").select("order_id").collect()] == ["ORD-5"]
    s = read("summaries").agg(F.sum("processed"), F.sum("skipped"), F.sum("errors")).first()
    assert tuple(s) == (2, 3, 1)
    # replay the same files from scratch (new checkpoint): nothing new is written
    SD.run_decisions(spark, f"{base}/src", f"{base}/out", f"{base}/ck2")
    assert read("actions").count() == read("decisions").count() == 2 and read("quarantine").count() == 1
    s = read("summaries").agg(F.sum("processed"), F.sum("skipped"), F.sum("errors")).first()
    assert tuple(s) == (2, 8, 2)  # the second stream has its own summaries: it decided nothing


def test_failure_between_the_two_writes(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="wholesail-test-stream-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    batch = records(spark, [("INSERT", "ORD-1", t, img("ORD-1")), ("INSERT", "ORD-2", t, img("ORD-2"))])
    whole = SD.upsert_if_absent

    def fails(spark, df, path, key, first_by, name):
        if path.endswith("/actions"):
            raise OSError("executor lost")
        return whole(spark, df, path, key, first_by, name)

    monkeypatch.setattr(SD, "upsert_if_absent", fails)
    with pytest.raises(OSError):
        SD.process_batch(spark, batch, 0, base)
    assert spark.read.parquet(f"{base}/decisions").count() == 2
    monkeypatch.setattr(SD, "upsert_if_absent", whole)
    for _ in range(2):
        SD.process_batch(spark, batch, 0, base)
        assert spark.read.parquet(f"{base}/actions").count() == 2
        assert spark.read.parquet(f"{base}/decisions").count() == 2
        assert [tuple(r)[:3] for r in spark.read.parquet(f"{base}/summaries").collect()] == [(2, 0, 0)]


def test_outer_id_is_used_and_sentinels_are_absent(spark):
    base = tempfile.mkdtemp(prefix="wholesail-test-stream-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("INSERT", "ORD-7", t, (None, "C-1", "premium", "credit", "1000", "0.1", "0")),
        ("INSERT", "ORD-8", t, ("None", "nan", "null", "", "1000", "0.1", "0")),
        ("INSERT", None, t, (None, "C-1", "premium", "credit", "1000", "0.1", "0")),
        (None, "ORD-9", t, img("ORD-9")),
    ]
    for _ in range(2):
        SD.process_batch(spark, records(spark, rows), 0, base)
    got = {r["order_id"]: r for r in spark.read.parquet(f"{base}/actions").collect()}
    assert sorted(got) == ["ORD-7", "ORD-8"] and got["ORD-8"]["customer_segment"] == got["ORD-8"]["customer_id"] == ""
    assert got["ORD-7"]["actioned_at"] == t
    assert spark.read.parquet(f"{base}/decisions").count() == 2