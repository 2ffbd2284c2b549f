"""Registered queries that run Structured Streaming jobs (availableNow) and read their sinks.

Each stream replays data Spark derives from the driver tables, written as time-ordered files in
a fresh folder under the session's checkpoint directory; its result must equal the batch path
(the oracle SQL is the batch definition, restricted to what an append-mode stream can emit)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.eventlog import read_events
from ..sources.logstore import stored_order_heads
from ..streaming import decisions as SD
from ..streaming import fraud as SF
from ..streaming import ingest as SI
from ..streaming import lifecycle as SL
from ..streaming import metrics as SM
from .oracle import _CTES as CTES
from .oracle import D_US, cte, sql
from .q_decision import enriched
from .q_projections import log_of, tables_of
from .q_rules import FRAUD_SCORE_SQL
from .registry import query

STATUS_TYPES = ["OrderShipped", "OrderDelivered", "OrderCancelled", "OrderReturned", "InvoiceCreated"]


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/wholesail-{name}-{uuid.uuid4().hex[:10]}"


@query("stream_decision_audit", sql("SELECT * FROM audit_t", "audit_t"), "M1 M2 M3 M4 J9 J10 A10 A11 B4 B5 B6 B8")
def q_stream_decisions(spark, d):
    base = scratch(spark, "decisions")
    per = SD.write_change_records(SD.change_records(enriched(spark, d)), f"{base}/source", files=4)
    SD.run_decisions(spark, f"{base}/source", f"{base}/out", f"{base}/_checkpoint", files_per_trigger=per)
    return spark.read.parquet(f"{base}/out/actions").drop("batch_id", "actioned_at", "bucket", "batch")


@query("stream_event_metrics", sql(f"""
SELECT make_timestamp(b * 300000000) AS window_start, make_timestamp(b * 300000000 + 300000000) AS window_end,
       count(*) AS events, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS value_sum,
       list_sort(list(value))[CAST(ceil(count(*) * 0.99) AS BIGINT)] AS value_p99
FROM (SELECT epoch_us(ts) // 300000000 AS b, value FROM events)
GROUP BY b HAVING b * 300000000 + 300000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""",), "M5 M7")
def q_stream_metrics(spark, d):
    from ..sources.tables import load_table

    base = scratch(spark, "metrics")
    ev = load_table(spark, d, "events")
    per = SM.write_time_sliced(ev, f"{base}/source", "ts", files=6)
    SM.run_window_stream(spark, f"{base}/source", ev.schema, f"{base}/out", f"{base}/_checkpoint",
                         watermark="10 minutes", width="5 minutes", files_per_trigger=per)
    # a window holds far fewer events than the sketch's accuracy, so its p99 is the exact one
    return spark.read.parquet(f"{base}/out").select("window_start", "window_end", "events", "value_sum", "value_p99")


@query("stream_late_share", sql("""
SELECT count(*) AS rows, count(*) FILTER (late) AS late, count(*) FILTER (late) / count(*) AS late_share
FROM (SELECT epoch_us(ts) < epoch_us(max(ts) OVER (ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) - 600000000 AS late
      FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS TIMESTAMP) + to_seconds(event_id % 7 * 60 + CASE WHEN event_id % 97 = 0 THEN 7200 ELSE 0 END) AS arrival FROM events))"""), "M7")
def q_late_share(spark, d):
    """Events that arrive some minutes late, one in 97 two hours late, against a watermark of ten minutes."""
    from ..sources.tables import load_table

    ev = load_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    delay = F.col("event_id") % 7 * 60 + F.when(F.col("event_id") % 97 == 0, 7200).otherwise(0)
    ev = ev.withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + delay * 1_000_000))
    return SM.late_share(ev, "ts", "arrival", 600_000_000)


# --- the decision chain over a stream with faults -----------------------------------------------------
cte("enriched_f", """
SELECT * REPLACE (CASE WHEN k % 23 = 0 THEN 0.5::DOUBLE ELSE fraud_score END AS fraud_score,
                  CASE WHEN k % 23 = 0 THEN NULL ELSE customer_segment END AS customer_segment)
FROM (SELECT *, CAST(split_part(order_id, '-', 2) AS BIGINT) AS k FROM enriched)
WHERE k % 11 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 29 <> 0""", ("enriched",))
for _name, _from in (("factors", "enriched"), ("scored", "factors"), ("decided", "scored"), ("routed", "decided"), ("audit_t", "routed")):
    cte(f"{_name}_f", re.sub(rf"\b{_from}\b", f"{_from}_f", CTES[_name][0]), tuple(f"{x}_f" if x == _from else x for x in CTES[_name][1]))
cte("faulty", """
SELECT order_id, CAST(split_part(order_id, '-', 2) AS BIGINT) AS k, created_at + to_days(CAST(3 * r.r AS INTEGER)) AS at
FROM orders_t, (SELECT unnest([0, 1]) AS r) r WHERE r.r = 0 OR CAST(split_part(order_id, '-', 2) AS BIGINT) % 13 = 0""", ("orders_t",))
_RUNS: dict[tuple[str, str], str] = {}


def faulty_records(enriched_orders):
    """Change records with faults by order number k: no number as amount (k % 11 = 0), delivered again three days later
    (13), no id anywhere (17), REMOVE (19), sentinels for segment and fraud score (23), no image (29)."""
    k = F.substring_index("order_id", "-", -1).cast("long")
    r = SD.change_records(enriched_orders).withColumn("k", k)
    img = F.col("new_image")
    img = img.withField("total_amount", F.when(F.col("k") % 11 == 0, F.concat(img["total_amount"], F.lit("x"))).otherwise(img["total_amount"]))
    img = img.withField("customer_segment", F.when(F.col("k") % 23 == 0, "None").otherwise(img["customer_segment"]))
    img = img.withField("fraud_score", F.when(F.col("k") % 23 == 0, "nan").otherwise(img["fraud_score"]))
    img = img.withField("order_id", F.when(F.col("k") % 17 == 0, "").otherwise(img["order_id"]))
    r = r.withColumn("new_image", F.when(F.col("k") % 29 != 0, img))
    r = r.withColumn("order_id", F.when(F.col("k") % 17 != 0, F.col("order_id")))
    r = r.withColumn("event_name", F.when(F.col("k") % 19 == 0, "REMOVE").when(F.col("k") % 2 == 0, "MODIFY").otherwise("INSERT"))
    again = r.filter("k % 13 = 0").withColumn("approximate_ts", F.col("approximate_ts") + F.expr("interval 3 days"))
    return r.unionByName(again).drop("k")


def faulty_run(spark, d) -> str:
    """The chain over the faulty stream, once a session and source."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        base = scratch(spark, "faulty")
        per = SD.write_change_records(faulty_records(enriched(spark, d)), f"{base}/source", files=4)
        SD.run_decisions(spark, f"{base}/source", f"{base}/out", f"{base}/_checkpoint", files_per_trigger=per)
        _RUNS[key] = f"{base}/out"
    return _RUNS[key]


@query("stream_faulty_actions", sql("SELECT * FROM audit_t_f", "audit_t_f"), "M3 M4 J9 B8")
def q_faulty_actions(spark, d):
    return spark.read.parquet(f"{faulty_run(spark, d)}/actions").drop("batch_id", "actioned_at", "bucket", "batch")


@query("stream_faulty_quarantine", sql("""
SELECT f.order_id, f.at AS approximate_ts, e.customer_id
FROM faulty f JOIN enriched e USING (order_id)
WHERE k % 11 = 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 29 <> 0""", "faulty", "enriched"), "M4 B5")
def q_faulty_quarantine(spark, d):
    return spark.read.parquet(f"{faulty_run(spark, d)}/quarantine").select("order_id", "approximate_ts", "customer_id")


@query("stream_faulty_summary", sql("""
SELECT count(DISTINCT order_id) FILTER (ok AND k % 11 <> 0) AS processed,
       count(*) - count(DISTINCT order_id) FILTER (ok AND k % 11 <> 0) - count(*) FILTER (ok AND k % 11 = 0) AS skipped,
       count(*) FILTER (ok AND k % 11 = 0) AS errors
FROM (SELECT *, k % 17 <> 0 AND k % 19 <> 0 AND k % 29 <> 0 AS ok FROM faulty)""", "faulty"), "J10 M4")
def q_faulty_summary(spark, d):
    s = spark.read.parquet(f"{faulty_run(spark, d)}/summaries")
    return s.agg(*[F.sum(c).cast("long").alias(c) for c in ("processed", "skipped", "errors")])


cte("lcs_cand", f"""
SELECT customer_id, event_type, timestamp, days_without_order, days_inactive, channel, final
FROM (
  SELECT customer_id, 'CustomerBecameInactive' AS event_type, last_ts + INTERVAL 60 DAY AS timestamp,
         60 AS days_without_order, CAST(NULL AS INTEGER) AS days_inactive, CAST(NULL AS VARCHAR) AS channel,
         next_ts IS NULL AS final FROM lc_gap WHERE gap >= 60 * {D_US}
  UNION ALL SELECT customer_id, 'CustomerBecameDormant', last_ts + INTERVAL 150 DAY, 150, NULL, NULL,
         next_ts IS NULL FROM lc_gap WHERE gap >= 150 * {D_US}
  UNION ALL SELECT customer_id, 'CustomerChurned', last_ts + INTERVAL 330 DAY, 330, NULL, NULL,
         next_ts IS NULL FROM lc_gap WHERE gap >= 330 * {D_US}
  UNION ALL SELECT customer_id, 'CustomerReactivated', next_ts, NULL, CAST(gap // {D_US} AS INTEGER), next_channel,
         false FROM lc_gap WHERE next_ts IS NOT NULL AND gap >= 60 * {D_US} AND gap < 330 * {D_US})""", ("lc_gap",))


@query("stream_lifecycle", sql("""
SELECT customer_id, event_type, timestamp, days_without_order, days_inactive, channel
FROM (SELECT *, min(CASE WHEN event_type = 'CustomerChurned' THEN timestamp END)
                OVER (PARTITION BY customer_id) AS churn_ts FROM lcs_cand)
WHERE (churn_ts IS NULL OR timestamp <= churn_ts)
  AND (NOT final OR timestamp < (SELECT max(created_at) FROM ord) - INTERVAL 1 DAY)""", "lcs_cand", "ord"),
    "M8 L10")
def q_stream_lifecycle(spark, d):
    o = tables_of(spark, d)["orders"].select("customer_id", F.col("created_at").alias("ts"), "channel", F.lit("order").alias("kind"))
    c = tables_of(spark, d)["customers"].select("customer_id", F.col("created_at").alias("ts"),
                                F.lit(None).cast("string").alias("channel"), F.lit("created").alias("kind"))
    base = scratch(spark, "lifecycle")
    per = SM.write_time_sliced(c.unionByName(o), f"{base}/source", "ts", files=8)
    schema = "customer_id string, ts timestamp, channel string, kind string"
    SL.run_lifecycle_stream(spark, f"{base}/source", schema, f"{base}/out", f"{base}/_checkpoint", watermark="1 day",
                            files_per_trigger=per)
    return spark.read.parquet(f"{base}/out")


@query("stream_ingest_dedup", sql("""
SELECT event_type, count(*) AS events FROM (
  SELECT 'OrderShipped' AS event_type FROM ord WHERE orderstatus IN ('O', 'F')
  UNION ALL SELECT 'OrderDelivered' FROM ord WHERE orderstatus = 'F'
  UNION ALL SELECT 'OrderReturned' FROM ord WHERE orderstatus = 'F' AND orderkey % 20 = 0
  UNION ALL SELECT 'OrderCancelled' FROM ord WHERE orderstatus = 'P' AND orderkey % 25 = 0)
GROUP BY event_type""", "ord"), "A3 A10 M3")
def q_stream_ingest(spark, d):
    log = log_of(spark, d)
    base = scratch(spark, "ingest")
    src = read_events(log, *STATUS_TYPES)
    # every event delivered twice, in different files, plus types the filter must drop
    per = SM.write_time_sliced(src, f"{base}/source/copy1", "timestamp", files=3)
    SM.write_time_sliced(src, f"{base}/source/copy2", "timestamp", files=2, per_slice=per)
    SI.run_ingest(spark, f"{base}/source/*", f"{base}/log", f"{base}/_checkpoint",
                  event_types=STATUS_TYPES[:4], files_per_trigger=2 * per)
    return spark.read.parquet(f"{base}/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("stream_order_windows", sql("""
SELECT customer_id, make_timestamp(b * 21600000000) AS window_start,
       make_timestamp(b * 21600000000 + 86400000000) AS window_end,
       count(*) AS events, CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) AS value_sum
FROM (SELECT customer_id, total_value, epoch_us(created_at) // 21600000000 - k.k AS b
      FROM orders_t, (SELECT unnest([0, 1, 2, 3]) AS k) k)
GROUP BY customer_id, b
HAVING b * 21600000000 + 86400000000 <= (SELECT epoch_us(max(created_at)) - 86400000000 FROM orders_t)""",
    "orders_t"), "M6 L4")
def q_stream_order_windows(spark, d):
    """Sliding 24 h windows every 6 h per customer, in append mode behind a 1-day watermark."""
    o = stored_order_heads(spark, d).select("customer_id", F.col("timestamp").alias("ts"), F.col("total_value").alias("value"))
    base = scratch(spark, "order-windows")
    per = SM.write_time_sliced(o, f"{base}/source", "ts", files=4, most_rows=SM.ROWS_PER_SLICE)
    SM.run_window_stream(spark, f"{base}/source", o.schema, f"{base}/out", f"{base}/_checkpoint",
                         watermark="1 day", width="24 hours", slide="6 hours", by=("customer_id",),
                         files_per_trigger=per)
    return spark.read.parquet(f"{base}/out").select("customer_id", "window_start", "window_end", "events",
                                                    "value_sum")


@query("stream_fraud_features", sql(f"""
SELECT o.order_id, o.customer_id, v.velocity_24h, p.avg_prev,
       {FRAUD_SCORE_SQL.format(v='v.velocity_24h', avg='p.avg_prev', val='o.total_value', risk='coalesce(c.risk_score, 0.0::DOUBLE)')} AS fraud_model_score
FROM feat_o o JOIN feat_vel v ON o.order_id = v.order_id JOIN feat_prev p ON o.order_id = p.order_id
LEFT JOIN cust c ON o.customer_id = c.customer_id""", "feat_o", "feat_vel", "feat_prev", "cust"), "M8 L1 L2 L3")
def q_stream_fraud(spark, d):
    o = tables_of(spark, d)["orders"].select("order_id", "customer_id", "created_at", "total_value")
    base = scratch(spark, "fraud")
    per = SM.write_time_sliced(o, f"{base}/source", "created_at", files=4)
    SF.run_fraud_stream(spark, f"{base}/source", tables_of(spark, d)["customers"], f"{base}/out", f"{base}/_checkpoint",
                        files_per_trigger=per)
    return spark.read.parquet(f"{base}/out")
