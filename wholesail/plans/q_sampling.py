"""Registered queries: the stratified multi-table sampler (G1–G11, A14, A15) and A/B metrics (K6, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from ..operators import sampling as G
from .oracle import cte, sql
from .registry import query

SEED = 42
DAYS = 90
CAP = 3000  # total rows per sample (the sampler's trimming feature)
SAMPLE_TABLES = [
    "orders", "order_lines", "invoices", "payments", "stockout_events", "credit_ledger", "customer_history",
    "rep_performance", "customers", "rfm_scores",
]


def last_90d_config(cap: int | None = CAP) -> G.SamplerConfig:
    T, J = G.TableSpec, G.JoinSpec
    return G.SamplerConfig(
        tables=[
            T("orders", filter="date_window", split_anchor=True, key="order_id"),
            T("order_lines", join=J("orders", "order_id")),
            T("invoices", join=J("orders", "order_id"), key="invoice_id"),
            T("payments", join=J("invoices", "invoice_id")),
            T("stockout_events", join=J("orders", "order_id"), filter="date_window"),
            T("credit_ledger", join=J("orders", "customer_id"), filter="date_window", key="event_id"),
            T("customer_history", join=J("orders", "customer_id"), filter="date_window"),
            T("rep_performance", join=J("orders", "rep_id")),
            T("customers", join=J("orders", "customer_id"), key="customer_id"),
            T("rfm_scores", join=J("orders", "customer_id")),
            T("inventory_snapshot", static=True),
            T("monthly_customer_snapshot", static=True),
            T("promotion_roi", static=True),
        ],
        random_seed=SEED, anchor="latest", days=DAYS, stratify_by=["month", "channel", "status"],
        total_records_per_sample=cap,
    )


def run(spark, d, cap: int | None = CAP, preserve_keys: bool = False):
    tables = P.stored_projections(spark, d)  # the sampler reads projected tables, not the log
    return G.run_sampler(tables, last_90d_config(cap), preserve_keys=preserve_keys, apply_total_cap=cap is not None)


cte("smp_anchor", f"""
SELECT o.*, strftime(created_at, '%Y-%m') AS smonth,
       CAST(row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m'), channel, status
                               ORDER BY md5(concat('{SEED}|', order_id)), order_id) % 2 AS INTEGER) AS split
FROM orders_t o WHERE created_at >= (SELECT max(created_at) FROM orders_t) - INTERVAL {DAYS} DAY
""", ("orders_t",))

cte("smp_cut", f"SELECT max(created_at) - INTERVAL {DAYS} DAY AS cut FROM orders_t", ("orders_t",))

cte("smp_hist", """
SELECT customer_id, created_at AS timestamp FROM cust
UNION ALL SELECT customer_id, timestamp FROM lifecycle_t
""", ("cust", "lifecycle_t"))

cte("smp_counts", """
SELECT s.sample, t.tbl, t.n FROM (SELECT 'sample_a' AS sample, 0 AS split UNION ALL SELECT 'sample_b', 1) s,
LATERAL (
  SELECT 'orders' AS tbl, count(*) AS n FROM smp_anchor a WHERE a.split = s.split
  UNION ALL SELECT 'order_lines', count(*) FROM lines
    WHERE order_id IN (SELECT order_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'invoices', count(*) FROM invoices_t
    WHERE order_id IN (SELECT order_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'payments', count(*) FROM payments_t WHERE invoice_id IN (
    SELECT invoice_id FROM invoices_t WHERE order_id IN (SELECT order_id FROM smp_anchor a WHERE a.split = s.split))
  UNION ALL SELECT 'stockout_events', count(*) FROM stockouts_t
    WHERE timestamp >= (SELECT cut FROM smp_cut)
      AND order_id IN (SELECT order_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'credit_ledger', count(*) FROM ledger_t
    WHERE timestamp >= (SELECT cut FROM smp_cut)
      AND customer_id IN (SELECT customer_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'customer_history', count(*) FROM smp_hist
    WHERE timestamp >= (SELECT cut FROM smp_cut)
      AND customer_id IN (SELECT customer_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'rep_performance', count(*) FROM rep_perf_t
    WHERE rep_id IN (SELECT rep_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'customers', count(*) FROM cust
    WHERE customer_id IN (SELECT customer_id FROM smp_anchor a WHERE a.split = s.split)
  UNION ALL SELECT 'rfm_scores', count(*) FROM rfm_t
    WHERE customer_id IN (SELECT customer_id FROM smp_anchor a WHERE a.split = s.split)
) t
""", ("smp_anchor", "smp_cut", "smp_hist", "lines", "invoices_t", "payments_t", "stockouts_t", "ledger_t",
      "rep_perf_t", "cust", "rfm_t"))

cte("smp_capped", f"""
SELECT sample, tbl, n,
       CASE WHEN tot <= {CAP} THEN n
            WHEN n > greatest(1, CAST(floor(n * ({CAP}.0::DOUBLE / tot)) AS BIGINT))
            THEN greatest(1, CAST(floor(n * ({CAP}.0::DOUBLE / tot)) AS BIGINT)) ELSE n END AS rows
FROM (SELECT *, sum(n) OVER (PARTITION BY sample) AS tot FROM smp_counts)
""", ("smp_counts",))


@query("stratified_split", sql("""
SELECT order_id, smonth AS month, channel, status, split FROM smp_anchor""", "smp_anchor"), "G1 G2 G3 G4 F2 T13")
def q_split(spark, d):
    o = P.stored_projections(spark, d)["orders"]
    anchor = G.resolve_anchor(o, "latest")
    a = G.stratified_split(G.date_window(o, anchor, DAYS), ["month", "channel", "status"], "order_id", SEED)
    return a.select("order_id", F.date_format("created_at", "yyyy-MM").alias("month"), "channel", "status",
                    F.col("_split").alias("split"))


@query("sample_manifest", sql("""
SELECT sample, tbl AS "table", CAST(rows AS BIGINT) AS rows FROM smp_capped
UNION ALL SELECT 'reference', 'inventory_snapshot', count(*) FROM inventory_t
UNION ALL SELECT 'reference', 'monthly_customer_snapshot', count(*) FROM
  (SELECT DISTINCT date_trunc('month', timestamp), event_type FROM lc_all)
UNION ALL SELECT 'reference', 'promotion_roi', count(DISTINCT promotion_id) FROM promo_applied""",
    "smp_capped", "inventory_t", "lc_all", "promo_applied"), "G5 G6 G7 G10 G11 D4 D7 A14 A15 T11")
def q_manifest(spark, d):
    return G.manifest(run(spark, d))


@query("sample_a_orders", sql(f"""
SELECT order_id, customer_id, created_at, channel, status FROM (
  SELECT a.*, row_number() OVER (ORDER BY md5(concat('{SEED}|', order_id)), order_id) AS rk
  FROM smp_anchor a WHERE split = 0)
WHERE rk <= (SELECT rows FROM smp_capped WHERE sample = 'sample_a' AND tbl = 'orders')""",
    "smp_anchor", "smp_capped"), "G7 G8 I1")
def q_sample_a_orders(spark, d):
    return run(spark, d).samples["sample_a"]["orders"].select("order_id", "customer_id", "created_at", "channel",
                                                               "status")


cte("smp_kpi", """
SELECT split, count(*) AS orders, CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) AS gmv,
       CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) / count(*) AS aov,
       count(DISTINCT customer_id) AS customers, count(*) FILTER (WHERE fraud_score > 0.5) AS high_fraud_orders
FROM smp_anchor GROUP BY split
""", ("smp_anchor",))

cte("smp_kpi_long", """
SELECT split, 'orders' AS metric, CAST(orders AS DOUBLE) AS v FROM smp_kpi
UNION ALL SELECT split, 'gmv', gmv FROM smp_kpi UNION ALL SELECT split, 'aov', aov FROM smp_kpi
UNION ALL SELECT split, 'customers', CAST(customers AS DOUBLE) FROM smp_kpi
UNION ALL SELECT split, 'high_fraud_orders', CAST(high_fraud_orders AS DOUBLE) FROM smp_kpi
""", ("smp_kpi",))


@query("ab_kpi_compare", sql("""
SELECT a.metric, a.v AS a, b.v AS b, CASE WHEN a.v <> 0 THEN (b.v - a.v) / a.v * 100 END AS delta_pct
FROM smp_kpi_long a JOIN smp_kpi_long b ON a.metric = b.metric AND a.split = 0 AND b.split = 1""",
    "smp_kpi_long"), "K6")
def q_ab_kpi(spark, d):
    r = run(spark, d, cap=None)
    return G.compare_kpis(r.samples["sample_a"]["orders"], r.samples["sample_b"]["orders"])


@query("ab_channel_status_mix", sql("""
SELECT CASE split WHEN 0 THEN 'sample_a' ELSE 'sample_b' END AS sample, channel, status, count(*) AS count
FROM smp_anchor GROUP BY 1, 2, 3""", "smp_anchor"), "K7 F11")
def q_ab_mix(spark, d):
    r = run(spark, d, cap=None)
    tagged = G.tag_samples({k: v["orders"] for k, v in r.samples.items()})
    return tagged.groupBy("sample", "channel", "status").agg(F.count(F.lit(1)).alias("count"))
