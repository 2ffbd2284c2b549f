"""Time slices for stream replay are as many files as their rows need, and a batch is one slice; bucketed state."""

import tempfile

from pyspark.sql import functions as F

from wholesail.sources import files
from wholesail.streaming import buckets, fraud, metrics


def folder():
    return tempfile.mkdtemp(prefix="wholesail-test-slices-", dir="/tmp")


def test_a_slice_is_dealt_over_files(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ROWS_PER_FILE", 100)
    rows = spark.range(1000).selectExpr("id", "timestamp_seconds(id) ts")
    base = folder()
    per = metrics.write_time_sliced(rows, f"{base}/src", "ts", files=2)
    assert per == 5 and files.data_files(spark, f"{base}/src") == 10
    sizes = spark.read.parquet(f"{base}/src").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 300


def test_a_batch_is_one_slice_even_of_few_rows(spark):
    """Two rows of each slice in four files: no later slice comes into a batch, or its watermark would drop rows."""
    rows = spark.range(8).selectExpr("id", "timestamp_seconds(id * 86400 * 30) ts")
    base, seen = folder(), []
    per = metrics.write_time_sliced(rows, f"{base}/src", "ts", files=4, per_slice=4)
    assert files.data_files(spark, f"{base}/src") == 16
    s = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", per).parquet(f"{base}/src")
    q = (s.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r["id"] for r in df.collect())))
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert seen == sorted(seen) and sorted(sum(seen, [])) == list(range(8)) and all(max(x) - min(x) <= 2 for x in seen)


def test_bucketed_state_of_recent_orders(spark, monkeypatch):
    monkeypatch.setattr(fraud, "bucket_of", lambda key: buckets.bucket_of(key, 3))
    o = spark.range(400).selectExpr("concat('O', id) order_id", "if(id % 40 = 39, null, concat('C', id % 40)) customer_id",
                                    "timestamp_seconds(id * 2000) created_at", "cast(id as double) total_value")
    c = spark.range(40).selectExpr("concat('C', id) customer_id", "0.5D risk_score")
    base = folder()
    per = metrics.write_time_sliced(o, f"{base}/src", "created_at", files=3, per_slice=2)
    q = fraud.run_fraud_stream(spark, f"{base}/src", c, f"{base}/out", f"{base}/ck", files_per_trigger=per)
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 3
    got = {r["order_id"]: (r["customer_id"], r["velocity_24h"], r["avg_prev"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert len(got) == 400
    for i in range(400):
        past = [j for j in range(i % 40, i, 40)]
        day = sum((i - j) * 2000 <= 86400 for j in past)
        assert got[f"O{i}"] == (None if i % 40 == 39 else f"C{i % 40}", day, sum(past) / len(past) if past else 0.0)


def test_pack_and_unpack():
    rows = [("a", 1), (None, 2)]
    f = {"k": "string", "n": "int64"}
    assert list(buckets.unpack(buckets.pack(f, rows))) == rows and list(buckets.unpack(buckets.pack(f, []))) == []
