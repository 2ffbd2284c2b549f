"""Registered queries: dashboard metrics and the analyst cookbook."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cookbook as K
from .oracle import sql
from .q_projections import tables_of
from .registry import query

DSUM = "CAST(sum(CAST({c} AS DECIMAL(20, 2))) AS DOUBLE)"


def dsum(c: str) -> str:
    return DSUM.format(c=c)


@query("kpi_tile", sql(f"""
SELECT count(*) AS orders, {dsum('total_value')} AS gmv, {dsum('total_value')} / count(*) AS aov,
       count(DISTINCT customer_id) AS customers, count(*) FILTER (WHERE fraud_score > 0.5) AS high_fraud_orders
FROM orders_t""", "orders_t"), "K1 E4")
def q_kpi(spark, d):
    return K.kpi_tile(tables_of(spark, d)["orders"])


@query("orders_by_channel", sql("SELECT channel, count(*) AS count FROM orders_t GROUP BY channel", "orders_t"), "K2")
def q_by_channel(spark, d):
    return K.count_by(tables_of(spark, d)["orders"], "channel")


@query("orders_by_status", sql("SELECT status, count(*) AS count FROM orders_t GROUP BY status", "orders_t"), "K2")
def q_by_status(spark, d):
    return K.count_by(tables_of(spark, d)["orders"], "status")


@query("payment_method_mix", sql("""
SELECT payment_method, count(*) AS count FROM payments_t WHERE status = 'paid' GROUP BY payment_method""",
                                 "payments_t"), "K3")
def q_method_mix(spark, d):
    return K.count_by(tables_of(spark, d)["payments"].filter(F.col("status") == "paid"), "payment_method")


@query("customer_type_mix", sql("SELECT customer_type, count(*) AS count FROM cust GROUP BY customer_type", "cust"),
       "K3")
def q_type_mix(spark, d):
    return K.count_by(tables_of(spark, d)["customers"], "customer_type")


@query("fraud_histogram", sql("""
SELECT bin, b.lo + bin * ((b.hi - b.lo) / 30.0::DOUBLE) AS bin_start, count(*) AS count
FROM (SELECT CAST(CASE WHEN b.hi = b.lo THEN 0
                       ELSE least(floor((o.fraud_score - b.lo) / ((b.hi - b.lo) / 30.0::DOUBLE)), 29) END AS INTEGER) AS bin,
             b.lo, b.hi
      FROM orders_t o, (SELECT min(fraud_score) AS lo, max(fraud_score) AS hi FROM orders_t
                        WHERE fraud_score IS NOT NULL) b
      WHERE o.fraud_score IS NOT NULL) b
GROUP BY bin, b.lo, b.hi""", "orders_t"), "K4 E12")
def q_fraud_hist(spark, d):
    return K.histogram(tables_of(spark, d)["orders"], "fraud_score", 30)


@query("monthly_gmv_text", sql(f"""
SELECT strftime(created_at, '%Y-%m') AS month, {dsum('total_value')} AS gmv, count(*) AS orders
FROM orders_t GROUP BY 1""", "orders_t"), "K5 B13")
def q_monthly_text(spark, d):
    return K.monthly_gmv_text(tables_of(spark, d)["orders"])


@query("orders_with_customers", sql("""
SELECT o.order_id, o.created_at, o.total_value, o.status, o.channel, c.segment, c.area_id, c.customer_type,
       c.status AS customer_status
FROM orders_t o JOIN customers_t c ON o.customer_id = c.customer_id WHERE o.total_value > 0""",
                                    "orders_t", "customers_t"), "K8 D3")
def q_orders_customers(spark, d):
    return K.orders_with_customers(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


@query("order_invoice_payment", sql("""
SELECT o.order_id, o.created_at, o.total_value, i.invoice_id, i.due_date,
       p.status AS payment_status, p.timestamp AS paid_at, p.payment_method
FROM orders_t o JOIN invoices_t i ON o.order_id = i.order_id
LEFT JOIN payments_t p ON i.invoice_id = p.invoice_id AND p.status = 'paid'""",
                                    "orders_t", "invoices_t", "payments_t"), "K8 D9 D3")
def q_chain(spark, d):
    return K.order_invoice_payment(tables_of(spark, d)["orders"], tables_of(spark, d)["invoices"], tables_of(spark, d)["payments"])


@query("lines_with_orders", sql("""
SELECT l.order_id, l.sku_id, l.quantity, l.line_total, l.demand_class, o.created_at, o.channel
FROM lines l JOIN orders_t o ON l.order_id = o.order_id""", "lines", "orders_t"), "K8")
def q_lines_orders(spark, d):
    return K.lines_with_orders(tables_of(spark, d)["order_lines"], tables_of(spark, d)["orders"])


@query("rfm_with_customers", sql("""
SELECT r.customer_id, r.month, r.r_score, r.f_score, r.m_score, r.recency_days, r.monetary, c.segment, c.status,
       c.area_id
FROM rfm_t r JOIN customers_t c ON r.customer_id = c.customer_id""", "rfm_t", "customers_t"), "K8")
def q_rfm_customers(spark, d):
    return K.rfm_with_customers(tables_of(spark, d)["rfm_scores"], tables_of(spark, d)["customers"])


@query("clv_by_segment", sql(f"""
SELECT c.segment, count(DISTINCT o.customer_id) AS customers,
       {dsum('o.total_value')} / count(DISTINCT o.customer_id) AS avg_clv,
       {dsum('o.total_value')} / count(*) AS avg_order_value,
       CAST(count(o.order_id) AS DOUBLE) / count(DISTINCT o.customer_id) AS orders_per_customer
FROM orders_t o JOIN cust c ON o.customer_id = c.customer_id
WHERE o.status = 'OrderDelivered' AND o.total_value > 0
GROUP BY c.segment""", "orders_t", "cust"), "K10 E8")
def q_clv(spark, d):
    return K.clv_by_segment(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


@query("churn_by_cohort", sql("""
SELECT f.cohort_month, count(f.customer_id) AS cohort_size, count(ch.customer_id) AS churned,
       CAST(count(ch.customer_id) AS DOUBLE) * 100.0::DOUBLE / CAST(count(f.customer_id) AS DOUBLE) AS churn_pct
FROM (SELECT customer_id, date_trunc('month', min(created_at)) AS cohort_month FROM orders_t
      WHERE status = 'OrderDelivered' GROUP BY customer_id) f
LEFT JOIN (SELECT customer_id FROM lifecycle_t WHERE event_type = 'CustomerChurned') ch
       ON f.customer_id = ch.customer_id
GROUP BY f.cohort_month""", "orders_t", "lifecycle_t"), "K11 F8")
def q_churn_cohort(spark, d):
    return K.churn_by_cohort(tables_of(spark, d)["orders"], tables_of(spark, d)["customer_history"])


@query("dso_stats", sql("""
SELECT CAST(sum(d) AS DOUBLE) / count(d) AS avg_dso_days,
       round(quantile_cont(d, 0.5), 6) AS median_dso, round(quantile_cont(d, 0.9), 6) AS p90_dso
FROM (SELECT datediff('day', CAST(i.timestamp AS DATE), CAST(p.timestamp AS DATE)) AS d
      FROM invoices_t i JOIN payments_t p ON i.invoice_id = p.invoice_id WHERE p.status = 'paid')""",
                        "invoices_t", "payments_t"), "K12 E6 D3")
def q_dso(spark, d):
    return K.dso_stats(tables_of(spark, d)["invoices"], tables_of(spark, d)["payments"])


@query("rep_leaderboard", sql("""
SELECT rep_id, CAST(sum(total_visits) AS BIGINT) AS visits, CAST(sum(order_visits) AS BIGINT) AS orders_from_visits,
       CAST(sum(order_visits) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(total_visits) AS DOUBLE) AS conversion_pct,
       CAST(sum(CAST(gmv AS DECIMAL(20, 2))) AS DOUBLE) / 1000000.0::DOUBLE AS gmv_million
FROM rep_perf_t WHERE month >= (SELECT max(month) FROM rep_perf_t) - INTERVAL 5 MONTH
GROUP BY rep_id ORDER BY gmv_million DESC NULLS LAST, rep_id ASC LIMIT 10""", "rep_perf_t"), "K13 F6")
def q_rep_leaderboard(spark, d):
    return K.rep_leaderboard(tables_of(spark, d)["rep_performance"])


@query("sku_stockout_frequency", sql("""
SELECT sku_id, count(*) AS stockout_events,
       count(*) FILTER (WHERE resolution = 'cancel_line') AS cancellations,
       count(*) FILTER (WHERE resolution = 'substitute') AS substitutes,
       count(*) FILTER (WHERE resolution = 'backorder') AS backorders
FROM stockouts_t GROUP BY sku_id ORDER BY stockout_events DESC, sku_id ASC LIMIT 20""", "stockouts_t"),
    "K14 E10 F6")
def q_stockout_freq(spark, d):
    return K.sku_stockout_frequency(tables_of(spark, d)["stockout_events"])


@query("payment_mix_by_area", sql(f"""
SELECT c.area_id, p.payment_method, count(*) AS payments, {dsum('p.amount')} / 1000000.0::DOUBLE AS total_million
FROM payments_t p JOIN cust c ON p.customer_id = c.customer_id WHERE p.status = 'paid'
GROUP BY c.area_id, p.payment_method""", "payments_t", "cust"), "K15")
def q_payment_area(spark, d):
    return K.payment_mix_by_area(tables_of(spark, d)["payments"], tables_of(spark, d)["customers"])


@query("rfm_champions", sql("""
SELECT r.customer_id, c.name, c.segment, c.area_id, c.customer_type,
       CAST(r.r_score AS INTEGER) AS r, CAST(r.f_score AS INTEGER) AS f, CAST(r.m_score AS INTEGER) AS m,
       r.monetary AS trailing_gmv, r.recency_days
FROM rfm_t r JOIN cust c ON r.customer_id = c.customer_id
WHERE r.month = (SELECT max(month) FROM rfm_t)
  AND CAST(r.r_score AS INTEGER) >= 4 AND CAST(r.f_score AS INTEGER) >= 4 AND CAST(r.m_score AS INTEGER) >= 4""",
                            "rfm_t", "cust"), "K16 F7")
def q_champions(spark, d):
    return K.rfm_champions(tables_of(spark, d)["rfm_scores"], tables_of(spark, d)["customers"])


@query("credit_utilisation", sql("""
SELECT l.customer_id, c.segment, c.credit_limit, l.lowest_balance, l.peak_balance, l.current_balance,
       (c.credit_limit - l.current_balance) / nullif(c.credit_limit, 0) * 100 AS utilization_pct
FROM (SELECT customer_id, min(running_balance) AS lowest_balance, max(running_balance) AS peak_balance,
             arg_max(running_balance, {'t': timestamp, 'e': event_id}) AS current_balance
      FROM ledger_t GROUP BY customer_id) l
JOIN cust c ON l.customer_id = c.customer_id
ORDER BY utilization_pct DESC NULLS LAST, l.customer_id ASC LIMIT 20""", "ledger_t", "cust"), "K17 E7 T14")
def q_credit_util(spark, d):
    return K.credit_utilisation(tables_of(spark, d)["credit_ledger"], tables_of(spark, d)["customers"])


@query("month_over_month", sql(f"""
SELECT month, orders, gmv, lag(gmv) OVER (ORDER BY month) AS prev_gmv,
       gmv - lag(gmv) OVER (ORDER BY month) AS gmv_change,
       orders - lag(orders) OVER (ORDER BY month) AS orders_change
FROM (SELECT date_trunc('month', created_at) AS month, count(*) AS orders, {dsum('total_value')} AS gmv
      FROM orders_t GROUP BY 1)""", "orders_t"), "K19")
def q_mom(spark, d):
    return K.month_over_month(tables_of(spark, d)["orders"])


@query("time_profile", sql(f"""
SELECT hour(created_at) AS hour, dayofweek(created_at) + 1 AS dow, count(*) AS orders,
       {dsum('total_value')} AS gmv
FROM orders_t GROUP BY 1, 2""", "orders_t"), "K20")
def q_time_profile(spark, d):
    return K.time_profile(tables_of(spark, d)["orders"])


@query("revenue_concentration", sql("""
SELECT count(*) AS skus,
       CAST(sum(rev) FILTER (WHERE rk <= ceil(n * 0.1::DOUBLE)) AS DOUBLE) / CAST(sum(rev) AS DOUBLE) AS top10_share,
       CAST(sum(rev) FILTER (WHERE rk <= ceil(n * 0.5::DOUBLE)) AS DOUBLE) / CAST(sum(rev) AS DOUBLE) AS top50_share
FROM (SELECT rev, row_number() OVER (ORDER BY rev DESC, sku_id) AS rk, count(*) OVER () AS n
      FROM (SELECT sku_id, sum(CAST(line_total AS DECIMAL(20, 2))) AS rev FROM lines GROUP BY sku_id))""",
                                    "lines"), "K21")
def q_concentration(spark, d):
    return K.revenue_concentration(tables_of(spark, d)["order_lines"])


@query("return_rate_by_class", sql("""
SELECT l.demand_class, count(*) AS lines,
       CAST(count(*) FILTER (WHERE o.status = 'OrderReturned') AS DOUBLE) * 100.0::DOUBLE
         / CAST(count(*) AS DOUBLE) AS return_rate_pct
FROM lines l JOIN orders_t o ON l.order_id = o.order_id GROUP BY l.demand_class""", "lines", "orders_t"), "K22")
def q_return_rate(spark, d):
    return K.return_rate_by_class(tables_of(spark, d)["order_lines"], tables_of(spark, d)["orders"])


@query("aov_by_area", sql(f"""
SELECT c.area_id, count(*) AS orders, {dsum('o.total_value')} / count(*) AS aov
FROM orders_t o JOIN cust c ON o.customer_id = c.customer_id GROUP BY c.area_id""", "orders_t", "cust"), "K22")
def q_aov_area(spark, d):
    return K.aov_by_area(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


@query("fraud_by_channel_status", sql("""
SELECT channel, status, count(*) AS orders,
       CAST(sum(CAST(fraud_score AS DECIMAL(20, 2))) AS DOUBLE) / count(fraud_score) AS mean_fraud
FROM orders_t GROUP BY channel, status""", "orders_t"), "K22")
def q_fraud_channel(spark, d):
    return K.fraud_by_channel_status(tables_of(spark, d)["orders"])


@query("segment_channel_economics", sql("""
SELECT segment, channel, orders, CAST(gmv AS DOUBLE) / orders AS aov,
       (CAST(gmv AS DOUBLE) / orders)
         / (CAST(sum(gmv) OVER (PARTITION BY segment) AS DOUBLE) / sum(orders) OVER (PARTITION BY segment)) AS aov_ratio,
       CAST(orders AS DOUBLE) / sum(orders) OVER (PARTITION BY segment) AS channel_share
FROM (SELECT c.segment, o.channel, count(*) AS orders, sum(CAST(o.total_value AS DECIMAL(20, 2))) AS gmv
      FROM orders_t o JOIN cust c ON o.customer_id = c.customer_id GROUP BY 1, 2)""", "orders_t", "cust"), "K23")
def q_seg_channel(spark, d):
    return K.segment_channel_economics(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


@query("ledger_ratios", sql("""
SELECT debits, credits, writeoffs, debits / credits AS debit_credit_ratio, writeoffs / debits AS writeoff_share
FROM (SELECT CAST(sum(CAST(amount AS DECIMAL(20, 2))) FILTER (WHERE transaction_type = 'debit') AS DOUBLE) AS debits,
             CAST(sum(CAST(amount AS DECIMAL(20, 2))) FILTER (WHERE transaction_type = 'credit') AS DOUBLE) AS credits,
             CAST(sum(CAST(amount AS DECIMAL(20, 2))) FILTER (WHERE transaction_type = 'writeoff') AS DOUBLE)
               AS writeoffs
      FROM ledger_t)""", "ledger_t"), "K24")
def q_ledger_ratios(spark, d):
    return K.ledger_ratios(tables_of(spark, d)["credit_ledger"])
