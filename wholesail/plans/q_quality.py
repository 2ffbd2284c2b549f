"""Registered queries: data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from ..operators import quality as H
from ..sources.eventlog import typed
from .oracle import D_US, sql
from .q_projections import log_of, tables_of
from .registry import query


def tables(log):
    return {n: fn(log) for n, fn in P.PROJECTIONS.items()}


@query("kpi_scorecard", sql(f"""
SELECT 'C1-no-orphan-orders' AS "check", n = 0 AS ok, CAST(n AS DOUBLE) AS value
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id FROM orders_t) o
      WHERE o.customer_id NOT IN (SELECT customer_id FROM cust))
UNION ALL
SELECT 'C2-line-totals-match', n = 0, CAST(n AS DOUBLE)
FROM (SELECT count(*) FILTER (WHERE abs(o.total_value - l.lines_total) > 0.02) AS n
      FROM orders_t o JOIN (SELECT order_id, CAST(sum(CAST(line_total AS DECIMAL(20, 2))) AS DOUBLE) AS lines_total
                            FROM lines GROUP BY order_id) l ON o.order_id = l.order_id)
UNION ALL
SELECT 'C3-credit-used-nonneg', n = 0, CAST(n AS DOUBLE)
FROM (SELECT count(*) FILTER (WHERE b < -0.01) AS n
      FROM (SELECT arg_max(running_balance, {{'t': timestamp, 'e': event_id}}) AS b FROM ledger_t GROUP BY customer_id))
UNION ALL
SELECT 'K1-avg-order-value', v >= 5000 AND v <= 460000, v
FROM (SELECT CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) / count(total_value) AS v FROM orders_t)
UNION ALL
SELECT 'K2-churn-rate', v >= 0.05 AND v <= 0.5, v
FROM (SELECT CAST(count(*) FILTER (WHERE status = 'churned') AS DOUBLE) / greatest(count(*), 1) AS v
      FROM customers_t)
UNION ALL
SELECT 'K3-dso-days', v >= 10 AND v <= 120, v
FROM (SELECT coalesce(CAST(sum(d) AS DOUBLE) / count(d), 30.0::DOUBLE) AS v
      FROM (SELECT (epoch_us(p.timestamp) - epoch_us(i.timestamp)) // {D_US} AS d
            FROM invoices_t i JOIN payments_t p ON i.invoice_id = p.invoice_id WHERE p.status = 'paid'))
UNION ALL
SELECT 'K4-stockout-rate', v >= 0.01 AND v <= 0.35, v
FROM (SELECT CAST(count(*) FILTER (WHERE estimated_on_hand <= 0) AS DOUBLE) / greatest(count(*), 1) AS v
      FROM inventory_t)
UNION ALL
SELECT 'K5-open-orders', v >= 0.05, v
FROM (SELECT CAST(count(*) FILTER (WHERE status <> 'OrderDelivered') AS DOUBLE) / greatest(count(*), 1) AS v
      FROM orders_t)
UNION ALL
SELECT 'K6-overdue-invoices', v >= 0.10, v
FROM (SELECT CAST(count(*) FILTER (WHERE invoice_id NOT IN (SELECT invoice_id FROM payments_t WHERE status = 'paid'))
                  AS DOUBLE) / greatest(count(*), 1) AS v FROM invoices_t)""",
    "orders_t", "cust", "lines", "ledger_t", "customers_t", "invoices_t", "payments_t", "inventory_t"),
    "H1 H2 H3 H4 H5 H6 H7 H8 H9 H10 D3 D5 E13 A7")
def q_scorecard(spark, d):
    return H.scorecard(tables_of(spark, d))


@query("order_row_validation", sql("""
SELECT count(*) AS orders,
       count(*) FILTER (WHERE coalesce(b.bad, false)) AS bad_line_total,
       count(*) FILTER (WHERE abs(o.total_value - coalesce(b.s, 0.0)) > 0.02) AS bad_order_total
FROM orders_t o LEFT JOIN (
  SELECT order_id, bool_or(abs(line_total - (quantity * unit_price - discount_amount)) > 0.02) AS bad,
         sum(line_total) AS s
  FROM lines GROUP BY order_id) b ON o.order_id = b.order_id""", "orders_t", "lines"), "H11")
def q_row_validation(spark, d):
    v = H.order_row_violations(typed(log_of(spark, d), "OrderCreated"))
    return v.agg(F.count(F.lit(1)).alias("orders"), F.count_if("bad_line_total").alias("bad_line_total"),
                 F.count_if("bad_order_total").alias("bad_order_total"))


@query("domain_rule_violations", sql("""
SELECT 'order_total_positive' AS rule_id, 'OrderCreated' AS event_type, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce(total_value > 0, false)) AS violations FROM orders_t
UNION ALL SELECT 'order_has_lines', 'OrderCreated', count(*),
       count(*) FILTER (WHERE orderkey NOT IN (SELECT l_orderkey FROM lineitem)) FROM orders_t
UNION ALL SELECT 'order_channel_enum', 'OrderCreated', count(*),
       count(*) FILTER (WHERE channel NOT IN ('rep', 'app', 'direct', 'organic')) FROM orders_t
UNION ALL SELECT 'order_fraud_unit', 'OrderCreated', count(*),
       count(*) FILTER (WHERE NOT coalesce(fraud_score BETWEEN 0 AND 1, false)) FROM orders_t
UNION ALL SELECT 'line_quantity_positive', 'OrderCreated', (SELECT count(*) FROM orders),
       count(DISTINCT order_id) FILTER (WHERE NOT coalesce(quantity > 0, false)) FROM lines
UNION ALL SELECT 'line_price_positive', 'OrderCreated', (SELECT count(*) FROM orders),
       count(DISTINCT order_id) FILTER (WHERE NOT coalesce(unit_price > 0 AND line_total > 0, false)) FROM lines
UNION ALL SELECT 'line_class_enum', 'OrderCreated', (SELECT count(*) FROM orders),
       count(DISTINCT order_id) FILTER (WHERE demand_class NOT IN ('A', 'B', 'C')) FROM lines
UNION ALL SELECT 'receipt_quantity_positive', 'StockReceived', count(*),
       count(*) FILTER (WHERE NOT coalesce(quantity > 0, false)) FROM stock_po
UNION ALL SELECT 'reserve_quantity_positive', 'StockReserved', count(*),
       count(*) FILTER (WHERE NOT coalesce(quantity > 0, false)) FROM lines WHERE l_linestatus = 'F'
UNION ALL SELECT 'stockout_requested_positive', 'StockoutOccurred', count(*),
       count(*) FILTER (WHERE NOT coalesce(requested_quantity > 0, false)) FROM stockouts_t
UNION ALL SELECT 'stockout_available_nonneg', 'StockoutOccurred', count(*),
       count(*) FILTER (WHERE NOT coalesce(available_quantity >= 0, false)) FROM stockouts_t
UNION ALL SELECT 'stockout_resolution_enum', 'StockoutOccurred', count(*),
       count(*) FILTER (WHERE resolution NOT IN ('substitute', 'backorder', 'cancel_line')) FROM stockouts_t
UNION ALL SELECT 'invoice_amount_positive', 'InvoiceCreated', count(*),
       count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) FROM invoices_t
UNION ALL SELECT 'invoice_terms_nonneg', 'InvoiceCreated', count(*),
       count(*) FILTER (WHERE NOT coalesce(terms_days >= 0, false)) FROM invoices_t
UNION ALL SELECT 'payment_amount_positive', 'PaymentCaptured', count(*),
       count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) FROM payments_t WHERE status = 'paid'
UNION ALL SELECT 'failed_attempt_positive', 'PaymentFailed', count(*),
       count(*) FILTER (WHERE NOT coalesce(attempt_number >= 1, false)) FROM payments_t WHERE status = 'failed'
UNION ALL SELECT 'visit_outcome_enum', 'RepVisitCompleted', count(*), 0 FROM visits_t
UNION ALL SELECT 'app_subtype_enum', 'AppSessionEvent', count(*), 0 FROM app_t
UNION ALL SELECT 'customer_risk_unit', 'CustomerCreated', count(*),
       count(*) FILTER (WHERE NOT coalesce(risk_score BETWEEN 0 AND 1, false)) FROM cust
UNION ALL SELECT 'customer_limit_nonneg', 'CustomerCreated', count(*),
       count(*) FILTER (WHERE NOT coalesce(credit_limit >= 0, false)) FROM cust""",
    "orders_t", "lines", "stock_po", "stockouts_t", "invoices_t", "payments_t", "visits_t", "app_t", "cust"),
    "H12 H16")
def q_domain_rules(spark, d):
    return H.domain_violations(log_of(spark, d))


@query("business_rule_violations", sql("""
SELECT 'CR-01' AS rule_id, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce((l.running_balance - l.signed_amount) + l.amount <= c.credit_limit, false))
         AS violations
FROM ledger_t l LEFT JOIN cust c ON l.customer_id = c.customer_id WHERE l.transaction_type = 'debit'
UNION ALL
SELECT 'CR-02', count(*), count(*) FILTER (WHERE ch.churned_at < o.created_at)
FROM orders_t o LEFT JOIN (SELECT customer_id, min(timestamp) AS churned_at FROM lifecycle_t
                           WHERE event_type = 'CustomerChurned' GROUP BY customer_id) ch
     ON o.customer_id = ch.customer_id
UNION ALL
SELECT 'INV-01', count(*), count(*) FILTER (WHERE NOT (available_quantity >= requested_quantity)) FROM stockouts_t
UNION ALL
SELECT 'PAY-01', count(*), count(*) FILTER (WHERE least(i.amount, p.captured) < p.captured)
FROM invoices_t i JOIN (SELECT invoice_id, CAST(sum(CAST(amount AS DECIMAL(20, 2))) AS DOUBLE) AS captured
                        FROM payments_t WHERE status = 'paid' GROUP BY invoice_id) p ON i.invoice_id = p.invoice_id
UNION ALL
SELECT 'COLL-01', count(*), count(*) FILTER (WHERE NOT coalesce(CAST(promise_date AS DATE) >= CAST(timestamp AS DATE), false))
FROM promises_t""",
    "promises_t", "ledger_t", "cust", "orders_t", "lifecycle_t", "stockouts_t", "invoices_t", "payments_t"), "H13")
def q_business_rules(spark, d):
    return H.business_rule_violations(
        tables_of(spark, d)["credit_ledger"], tables_of(spark, d)["customers"], tables_of(spark, d)["customer_history"], tables_of(spark, d)["orders"], tables_of(spark, d)["stockout_events"],
        tables_of(spark, d)["payments"], tables_of(spark, d)["invoices"],
        typed(log_of(spark, d), "CollectionPromiseMade", ["promise_date"]))


@query("duplicate_event_ids", sql("""
SELECT event_id, count(*) AS copies FROM (
  SELECT concat_ws('-', 'SR', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id FROM lines
  WHERE l_linestatus = 'F'
  UNION ALL SELECT concat_ws('-', 'SL', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lines
  WHERE l_linestatus = 'F' AND orderstatus = 'P' AND l_orderkey % 25 = 0
  UNION ALL SELECT concat_ws('-', 'SO', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lines
  WHERE l_linestatus = 'O' AND quantity > 45
  UNION ALL SELECT concat_ws('-', 'PA', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lines
  WHERE l_discount > 0)
GROUP BY event_id HAVING count(*) > 1""", "lines"), "H15 A3")
def q_dup_events(spark, d):
    return H.duplicate_keys(log_of(spark, d), "event_id")


@query("duplicate_order_ids", sql("""
SELECT order_id, count(*) AS copies FROM orders_t GROUP BY order_id HAVING count(*) > 1""", "orders_t"), "H15")
def q_dup_orders(spark, d):
    return H.duplicate_keys(tables_of(spark, d)["orders"], "order_id")


@query("impossible_values", sql("""
SELECT 'fraud_score<0' AS field, count(*) FILTER (WHERE fraud_score < 0) AS violations FROM orders_t
UNION ALL SELECT 'attempt_number<=0', count(*) FILTER (WHERE attempt_number <= 0) FROM payments_t
UNION ALL SELECT 'terms_days<0', count(*) FILTER (WHERE terms_days < 0) FROM invoices_t
UNION ALL SELECT 'stock<0', count(*) FILTER (WHERE estimated_on_hand < 0) FROM inventory_t
UNION ALL SELECT 'amount<0', count(*) FILTER (WHERE amount < 0) FROM payments_t""",
    "orders_t", "payments_t", "invoices_t", "inventory_t"), "H16")
def q_impossible(spark, d):
    return H.impossible_values(tables_of(spark, d)["orders"], tables_of(spark, d)["payments"], tables_of(spark, d)["invoices"], tables_of(spark, d)["inventory_snapshot"])


@query("paid_before_invoiced", sql("""
SELECT count(*) FILTER (WHERE p.timestamp < i.timestamp) AS violations
FROM invoices_t i JOIN payments_t p ON i.invoice_id = p.invoice_id WHERE p.status = 'paid'""",
    "invoices_t", "payments_t"), "H17")
def q_paid_before(spark, d):
    return H.paid_before_invoiced(tables_of(spark, d)["invoices"], tables_of(spark, d)["payments"])


@query("segment_null_coverage", sql("""
SELECT event_type, count(*) AS rows, count(segment) AS non_null, CAST(count(segment) AS DOUBLE) / count(*) AS coverage
FROM (SELECT 'CustomerCreated' AS event_type, segment FROM cust
      UNION ALL SELECT event_type, NULL FROM lifecycle_t) GROUP BY event_type""", "cust", "lifecycle_t"), "H18")
def q_null_coverage(spark, d):
    return H.null_coverage(tables_of(spark, d)["customer_history"], "event_type", "segment")


@query("unstable_sku_class", sql("""
SELECT sku_id, count(DISTINCT demand_class) AS "values" FROM lines GROUP BY sku_id
HAVING count(DISTINCT demand_class) > 1""", "lines"), "H19")
def q_unstable(spark, d):
    return H.unstable_dimension(tables_of(spark, d)["order_lines"], "sku_id", "demand_class")


@query("promotion_reconciliation", sql("""
SELECT (SELECT count(DISTINCT order_id) FROM promo_applied) AS orders_redeemed,
       (SELECT count(*) FROM promo_applied) AS redemptions,
       (SELECT count(*) FILTER (WHERE promotion_id IS NOT NULL) FROM orders_t) AS orders_with_promotion""",
    "promo_applied", "orders_t"), "H20")
def q_promo_recon(spark, d):
    log = log_of(spark, d)
    return H.promotion_reconciliation(typed(log, "PromotionApplied", ["order_id"]), tables_of(spark, d)["orders"])


@query("missing_order_days", sql("""
SELECT strftime(day, '%Y-%m-%d') AS day FROM (
  SELECT unnest(generate_series(min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE)), INTERVAL 1 DAY)) AS day
  FROM orders_t)
WHERE CAST(day AS DATE) NOT IN (SELECT DISTINCT CAST(created_at AS DATE) FROM orders_t)""", "orders_t"), "H21")
def q_missing_days(spark, d):
    return H.missing_days(tables_of(spark, d)["orders"], "created_at")
