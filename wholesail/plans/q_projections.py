"""Registered queries: sources (A), projections (C) and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from ..sources.logstore import stored_log
from ..sources.eventlog import event_count, type_registry_report
from .oracle import cte, sql
from .registry import query


def log_of(spark, sf_dir, *event_types, decoded=False):
    """The stored log, or its events of the types named: only the parts that hold them are stored for it."""
    return stored_log(spark, sf_dir, event_types or None, decoded)


def tables_of(spark, sf_dir):
    """The projected tables as stored parquet (C14) — what consumers of projections read."""
    return P.stored_projections(spark, sf_dir)


@query("orders", sql("""
SELECT order_id, customer_id, created_at, total_value, channel, rep_id, fraud_score, promotion_id, status
FROM orders_t""", "orders_t"), "C1 D1 E2 A1 B1")
def q_orders(spark, d):
    return P.orders(log_of(spark, d)).select(
        "order_id", "customer_id", "created_at", "total_value", "channel", "rep_id", "fraud_score", "promotion_id",
        "status",
    )


@query("order_lines", sql("""
SELECT order_id, customer_id, sku_id, quantity, unit_price, line_total, demand_class FROM lines""", "lines"),
    "C2 B2 B3")
def q_order_lines(spark, d):
    return P.order_lines(log_of(spark, d))


@query("customers", sql("""
SELECT customer_id, created_at, segment, credit_limit, acquisition_channel, rep_id, digital_active, customer_type,
       area_id, payment_method, risk_score, name, phone, status
FROM customers_t""", "customers_t"), "C3 D2 B10 L10")
def q_customers(spark, d):
    return P.customers(log_of(spark, d))


@query("customer_history", sql("""
SELECT c.customer_id, 'CustomerCreated' AS event_type, c.created_at AS timestamp, c.segment,
       CAST(NULL AS INTEGER) AS days_without_order
FROM cust c
UNION ALL
SELECT customer_id, event_type, timestamp, NULL, days_without_order FROM lifecycle_t""", "cust", "lifecycle_t"),
    "C4 L10")
def q_customer_history(spark, d):
    return P.customer_history(log_of(spark, d))


@query("inventory_snapshot", sql("""
SELECT sku_id, total_received, total_reserved, total_released, estimated_on_hand FROM inventory_t""",
                                 "inventory_t"), "C5")
def q_inventory(spark, d):
    return P.inventory_snapshot(log_of(spark, d))


@query("stockout_events", sql("""
SELECT sku_id, requested_quantity, available_quantity, order_id, resolution, sku_id_agg, timestamp
FROM stockouts_t""", "stockouts_t"), "C6")
def q_stockouts(spark, d):
    return P.stockout_events(log_of(spark, d))


@query("invoices", sql("""
SELECT invoice_id, order_id, customer_id, amount, due_date, terms_days, timestamp FROM invoices_t""",
                       "invoices_t"), "C7")
def q_invoices(spark, d):
    return P.invoices(log_of(spark, d))


@query("payments", sql("""
SELECT invoice_id, customer_id, amount, payment_method, attempt_number, reason, status, timestamp
FROM payments_t""", "payments_t"), "C8 F9")
def q_payments(spark, d):
    return P.payments(log_of(spark, d)).select(
        "invoice_id", "customer_id", "amount", "payment_method", "attempt_number", "reason", "status", "timestamp"
    )


@query("credit_ledger", sql("""
SELECT event_id, customer_id, timestamp, transaction_type, amount, signed_amount, running_balance
FROM ledger_t""", "ledger_t"), "C9 B12 F1 F9")
def q_ledger(spark, d):
    return P.credit_ledger(log_of(spark, d))


@query("rfm_scores", sql("""
SELECT customer_id, month, last_order_date, frequency, monetary, recency_days, r_score, f_score, m_score
FROM rfm_t""", "rfm_t"), "C10 E5 B13")
def q_rfm(spark, d):
    return P.rfm_scores(log_of(spark, d))


@query("monthly_customer_snapshot", sql("""
SELECT date_trunc('month', timestamp) AS month, event_type, count(*) AS count
FROM lc_all GROUP BY 1, 2""", "lc_all"), "C11")
def q_monthly_snapshot(spark, d):
    return P.monthly_customer_snapshot(log_of(spark, d))


@query("rep_performance", sql("""
SELECT rep_id, month, total_visits, order_visits, gmv FROM rep_perf_t""", "rep_perf_t"), "C13 D2 E3")
def q_rep_performance(spark, d):
    return P.rep_performance(log_of(spark, d))


@query("promotion_roi", sql("""
SELECT promotion_id,
       CAST(sum(CAST(original_value AS DECIMAL(20, 2))) AS DOUBLE) AS total_gmv,
       CAST(sum(CAST(discount_amount AS DECIMAL(22, 4))) AS DOUBLE) AS total_discount,
       count(*) AS redemptions,
       CAST(sum(CAST(original_value AS DECIMAL(20, 2))) AS DOUBLE)
         / greatest(CAST(sum(CAST(discount_amount AS DECIMAL(22, 4))) AS DOUBLE), 1.0::DOUBLE) AS roi
FROM promo_applied GROUP BY promotion_id""", "promo_applied"), "C12")
def q_promotion_roi(spark, d):
    return P.promotion_roi(log_of(spark, d))


@query("event_counts", sql("SELECT n AS events FROM total_events", "total_events"), "A5 A2 F9")
def q_event_count(spark, d):
    return event_count(log_of(spark, d))


@query("event_type_registry", sql("""
SELECT event_type, CAST(sum(n) AS BIGINT) AS events, event_type <> 'AppError' AS registered
FROM type_counts GROUP BY event_type HAVING sum(n) > 0""", "type_counts"), "L23 A2")
def q_type_registry(spark, d):
    return type_registry_report(log_of(spark, d))


@query("monthly_gmv", sql("""
SELECT date_trunc('month', created_at) AS month, count(*) AS order_count,
       CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) / 1000000.0::DOUBLE AS gmv_million,
       CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) / count(*) AS avg_order_value
FROM orders_t WHERE status = 'OrderDelivered' AND total_value > 0
GROUP BY 1""", "orders_t"), "K9")
def q_monthly_gmv(spark, d):
    o = P.orders(log_of(spark, d)).filter((F.col("status") == "OrderDelivered") & (F.col("total_value") > 0))
    s = F.sum(P.money("total_value")).cast("double")
    return o.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("order_count"),
        (s / F.lit(1e6)).alias("gmv_million"),
        (s / F.count(F.lit(1))).alias("avg_order_value"),
    )


cte("rfm12_base", f"""
SELECT r.customer_id, r.month, r.last_order_date, r.recency_days,
       count(o.order_id) AS frequency, CAST(sum(CAST(o.total_value AS DECIMAL(20, 2))) AS DOUBLE) AS monetary
FROM rfm_base r JOIN ord o ON o.customer_id = r.customer_id
 AND o.created_at >= r.month + INTERVAL 1 MONTH - INTERVAL 365 DAY AND o.created_at < r.month + INTERVAL 1 MONTH
GROUP BY r.customer_id, r.month, r.last_order_date, r.recency_days""", ("rfm_base", "ord"))

cte("rfm12_breaks", """
SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS rb,
       quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS fb,
       quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mb
FROM rfm12_base""", ("rfm12_base",))


@query("rfm_trailing_12m", sql("""
SELECT r.customer_id, r.month, r.last_order_date, r.frequency, r.monetary, r.recency_days,
       ['5', '4', '3', '2', '1'][len(list_filter(b.rb, lambda x: x < CAST(r.recency_days AS DOUBLE))) + 1] AS r_score,
       ['1', '2', '3', '4', '5'][len(list_filter(b.fb, lambda x: x < CAST(r.frequency AS DOUBLE))) + 1] AS f_score,
       ['1', '2', '3', '4', '5'][len(list_filter(b.mb, lambda x: x < r.monetary)) + 1] AS m_score
FROM rfm12_base r, rfm12_breaks b""", "rfm12_base", "rfm12_breaks"), "C10 T5 E5")
def q_rfm_trailing(spark, d):
    return P.rfm_trailing(tables_of(spark, d)["orders"], 365)
