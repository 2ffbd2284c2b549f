"""DuckDB oracle SQL: the domain rules restated directly over the driver's base tables.

The Spark side goes base tables → event log (JSON payloads) → projections; the oracle goes
straight from base tables to each result.  Agreement checks the log, the JSON round trip,
the projections and every operator in between.

``sql(body, *ctes)`` prefixes the body with the named CTEs (dependencies first).
"""

from __future__ import annotations

D_US = 86_400_000_000  # microseconds per day

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    _CTES[name] = (body.strip(), deps)


def sql(body: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS (\n{_CTES[n][0]}\n)" for n in order) + "\n" + body.strip()


# --- domain -------------------------------------------------------------------------------
cte("cust", """
SELECT c.c_custkey AS custkey,
       concat('C-', c.c_custkey) AS customer_id,
       TIMESTAMP '1994-12-01 00:00:00' AS created_at,
       CASE WHEN c.c_mktsegment IN ('BUILDING') THEN 'premium'
            WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'regular'
            ELSE 'low_volume' END AS segment,
       100000.0::DOUBLE + 100.0::DOUBLE * greatest(c.c_acctbal, 0.0::DOUBLE) AS credit_limit,
       ['rep', 'digital', 'referral'][c.c_custkey % 3 + 1] AS acquisition_channel,
       concat('REP-', lpad(CAST(c.c_custkey % 25 AS VARCHAR), 2, '0')) AS rep_id,
       c.c_custkey % 2 = 0 AS digital_active,
       ['grocery', 'pharmacy', 'kiosk', 'supermarket'][c.c_custkey % 4 + 1] AS customer_type,
       n.n_name AS area_id,
       ['credit', 'bank_transfer', 'direct_debit', 'cheque', 'cod', 'cash'][c.c_custkey % 6 + 1] AS payment_method,
       CAST(c.c_custkey % 100 AS DOUBLE) / 100.0::DOUBLE AS risk_score,
       c.c_name AS name,
       concat('+20-', lpad(CAST(c.c_custkey AS VARCHAR), 9, '0')) AS phone
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")

cte("ord", """
SELECT o_orderkey AS orderkey, o_custkey AS custkey,
       concat('ORD-', o_orderkey) AS order_id,
       concat('C-', o_custkey) AS customer_id,
       CASE WHEN o_custkey % 40 = 3 THEN TIMESTAMP '1999-03-30' ELSE CAST(o_orderdate AS TIMESTAMP) END
         + to_seconds(28800 + o_orderkey % 36000) AS created_at,
       o_totalprice AS total_value,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'rep' WHEN '2' THEN 'app' WHEN '3' THEN 'direct'
            ELSE 'organic' END AS channel,
       CASE WHEN substr(o_orderpriority, 1, 1) = '1'
            THEN concat('REP-', lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0')) END AS rep_id,
       CAST(o_orderkey % 97 AS DOUBLE) / 100.0::DOUBLE AS fraud_score,
       o_orderstatus AS orderstatus,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 20 = 0 THEN 'OrderReturned'
            WHEN o_orderstatus = 'F' THEN 'OrderDelivered'
            WHEN o_orderstatus = 'O' THEN 'OrderShipped'
            WHEN o_orderstatus = 'P' AND o_orderkey % 25 = 0 THEN 'OrderCancelled'
            ELSE 'OrderCreated' END AS status
FROM orders
""")

cte("lines", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_linestatus, l.l_discount,
       o.order_id, o.customer_id, o.custkey, o.created_at, o.orderstatus,
       concat('SKU-', l.l_partkey) AS sku_id,
       CAST(l.l_quantity AS BIGINT) AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price,
       l.l_extendedprice AS line_total,
       CASE WHEN p.p_size <= 17 THEN 'A' WHEN p.p_size <= 34 THEN 'B' ELSE 'C' END AS demand_class,
       l.l_discount > 0 AS promotion_applied,
       l.l_extendedprice * l.l_discount AS discount_amount
FROM lineitem l JOIN ord o ON l.l_orderkey = o.orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
""", ("ord",))

cte("order_promo", """
SELECT l_orderkey, CASE WHEN max(l_discount) > 0
       THEN concat('PROMO-', CAST(CAST(round(max(l_discount) * 100) AS INTEGER) AS VARCHAR)) END AS promotion_id
FROM lineitem GROUP BY l_orderkey
""")

cte("orders_t", """
SELECT o.order_id, o.customer_id, o.created_at, o.total_value, o.channel, o.rep_id, o.fraud_score,
       p.promotion_id, o.status, o.orderkey, o.custkey
FROM ord o LEFT JOIN order_promo p ON o.orderkey = p.l_orderkey
""", ("ord", "order_promo"))

cte("delivered", """
SELECT o.*, concat('INV-', o.orderkey) AS invoice_id,
       o.created_at + INTERVAL 4 DAY AS invoiced_at,
       ['credit', 'bank_transfer', 'direct_debit', 'cheque', 'cod', 'cash'][o.custkey % 6 + 1] AS payment_method,
       10 + o.orderkey % 60 AS base_days
FROM ord o WHERE o.orderstatus = 'F'
""", ("ord",))

cte("invoices_t", """
SELECT invoice_id, order_id, customer_id, total_value AS amount,
       strftime(invoiced_at + INTERVAL 30 DAY, '%Y-%m-%d') AS due_date, 30 AS terms_days,
       invoiced_at AS timestamp
FROM delivered
""", ("delivered",))

cte("payments_t", """
SELECT invoice_id, customer_id, total_value AS amount, payment_method, CAST(NULL AS INTEGER) AS attempt_number,
       CAST(NULL AS VARCHAR) AS reason, invoiced_at + to_days(CAST(base_days AS INTEGER)) AS timestamp,
       'paid' AS status, concat('PC-', orderkey, '-1') AS event_id
FROM delivered WHERE orderkey % 10 < 7
UNION ALL
SELECT invoice_id, customer_id, total_value, payment_method, NULL, NULL,
       invoiced_at + to_days(CAST(base_days + 7 AS INTEGER)), 'paid', concat('PC-', orderkey, '-2')
FROM delivered WHERE orderkey % 10 IN (7, 8)
UNION ALL
SELECT invoice_id, customer_id, total_value, NULL, a.n, 'insufficient_funds',
       invoiced_at + to_days(CAST(base_days + 7 * (a.n - 1) AS INTEGER)), 'failed', concat('PF-', orderkey, '-', a.n)
FROM delivered, (SELECT unnest([1, 2, 3]) AS n) a
WHERE (orderkey % 10 IN (7, 8) AND a.n = 1) OR (orderkey % 10 = 9)
""", ("delivered",))

cte("writeoffs_t", """
SELECT customer_id, invoice_id, total_value AS amount, 150 AS days_overdue,
       invoiced_at + INTERVAL 180 DAY AS timestamp, concat('CW-', orderkey, '-0') AS event_id
FROM delivered WHERE orderkey % 10 = 9
""", ("delivered",))

cte("ledger_src", """
SELECT concat('OC-', orderkey) AS event_id, customer_id, created_at AS timestamp, 'debit' AS transaction_type,
       total_value AS amount, total_value AS signed_amount FROM ord
UNION ALL
SELECT event_id, customer_id, timestamp, 'credit', amount, -amount FROM payments_t WHERE status = 'paid'
UNION ALL
SELECT event_id, customer_id, timestamp, 'writeoff', amount, -amount FROM writeoffs_t
""", ("ord", "payments_t", "writeoffs_t"))

cte("ledger_t", """
SELECT event_id, customer_id, timestamp, transaction_type, amount, signed_amount,
       CAST(sum(CAST(signed_amount AS DECIMAL(20, 2))) OVER (
            PARTITION BY customer_id ORDER BY timestamp, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_balance
FROM ledger_src
""", ("ledger_src",))

cte("stock_po", """
SELECT concat('SKU-', p_partkey) AS sku_id, concat('PO-', p_partkey) AS purchase_order_id,
       concat('SUP-', lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0')) AS supplier_id,
       CAST(1000 + 10 * p_size AS BIGINT) AS quantity,
       CAST(7 + p_partkey % 14 AS INTEGER) AS expected_lead_time_days,
       TIMESTAMP '1994-12-01 00:00:00' AS po_at,
       TIMESTAMP '1994-12-01 00:00:00' + to_days(CAST(7 + p_partkey % 14 + p_partkey % 5 AS INTEGER)) AS received_at
FROM part
""")

cte("stockouts_t", """
SELECT sku_id, quantity AS requested_quantity, quantity - 1 - l_orderkey % 45 AS available_quantity, order_id,
       ['cancel_line', 'cancel_line', 'cancel_line', 'cancel_line', 'cancel_line',
        'substitute', 'substitute', 'substitute', 'backorder', 'backorder'][(l_orderkey + l_linenumber) % 10 + 1] AS resolution,
       sku_id AS sku_id_agg, created_at AS timestamp
FROM lines WHERE l_linestatus = 'O' AND quantity > 45
""", ("lines",))

cte("inventory_t", """
SELECT r.sku_id, r.quantity AS total_received,
       coalesce(s.q, 0) AS total_reserved, coalesce(x.q, 0) AS total_released,
       r.quantity - coalesce(s.q, 0) + coalesce(x.q, 0) AS estimated_on_hand
FROM stock_po r
LEFT JOIN (SELECT sku_id, CAST(sum(quantity) AS BIGINT) AS q FROM lines WHERE l_linestatus = 'F' GROUP BY sku_id) s
       ON r.sku_id = s.sku_id
LEFT JOIN (SELECT sku_id, CAST(sum(quantity) AS BIGINT) AS q FROM lines
           WHERE l_linestatus = 'F' AND orderstatus = 'P' AND l_orderkey % 25 = 0 GROUP BY sku_id) x
       ON r.sku_id = x.sku_id
""", ("stock_po", "lines"))

cte("promo_applied", """
SELECT concat('PROMO-', CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR)) AS promotion_id,
       order_id, customer_id, discount_amount, line_total AS original_value, created_at AS timestamp
FROM lines WHERE l_discount > 0
""", ("lines",))

cte("visits_t", """
SELECT concat('REP-', lpad(CAST(user_id % 25 AS VARCHAR), 2, '0')) AS rep_id,
       concat('C-', user_id) AS customer_id,
       ['no_order', 'small_order', 'large_order', 'reactivation'][event_id % 4 + 1] AS outcome,
       CAST(ts AS TIMESTAMP) - INTERVAL 8217 DAY AS timestamp, concat('RV-', event_id) AS event_id
FROM events WHERE event_type = 'view'
""")

cte("app_t", """
SELECT concat('C-', user_id) AS customer_id,
       concat('S-', user_id, '-', strftime(CAST(ts AS TIMESTAMP) - INTERVAL 8217 DAY, '%Y%m%d')) AS session_id,
       CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'click' THEN 'screen_view'
            ELSE 'order_placed' END AS event_subtype,
       CAST(floor(value * 10) AS INTEGER) AS session_duration_seconds,
       event_type = 'purchase' AS led_to_order,
       CAST(ts AS TIMESTAMP) - INTERVAL 8217 DAY AS timestamp, concat('AS-', event_id) AS event_id
FROM events WHERE event_type IN ('signup', 'click', 'purchase')
""")

# L10 lifecycle, re-derived from orders (one anchor per customer creation and per order day)
cte("lc_anchor", """
SELECT customer_id, created_at AS first_ts, created_at AS last_ts, CAST(NULL AS VARCHAR) AS channel FROM cust
UNION ALL
SELECT customer_id, min(created_at), max(created_at), arg_min(channel, {'t': created_at, 'c': channel})
FROM ord GROUP BY customer_id, CAST(created_at AS DATE)
""", ("cust", "ord"))

cte("lc_gap", f"""
SELECT customer_id, last_ts, next_ts, next_channel,
       epoch_us(coalesce(next_ts, (SELECT max(created_at) FROM ord))) - epoch_us(last_ts) AS gap
FROM (SELECT *, lead(first_ts) OVER w AS next_ts, lead(channel) OVER w AS next_channel
      FROM lc_anchor WINDOW w AS (PARTITION BY customer_id ORDER BY first_ts, last_ts))
""", ("lc_anchor", "ord"))

cte("lc_cand", f"""
SELECT customer_id, 'CustomerBecameInactive' AS event_type, last_ts + INTERVAL 60 DAY AS timestamp,
       60 AS days_without_order, CAST(NULL AS INTEGER) AS days_inactive, CAST(NULL AS VARCHAR) AS channel
FROM lc_gap WHERE gap >= 60 * {D_US}
UNION ALL
SELECT customer_id, 'CustomerBecameDormant', last_ts + INTERVAL 150 DAY, 150, NULL, NULL
FROM lc_gap WHERE gap >= 150 * {D_US}
UNION ALL
SELECT customer_id, 'CustomerChurned', last_ts + INTERVAL 330 DAY, 330, NULL, NULL
FROM lc_gap WHERE gap >= 330 * {D_US}
UNION ALL
SELECT customer_id, 'CustomerReactivated', next_ts, NULL, CAST(gap // {D_US} AS INTEGER), next_channel
FROM lc_gap WHERE next_ts IS NOT NULL AND gap >= 60 * {D_US} AND gap < 330 * {D_US}
""", ("lc_gap",))

cte("lifecycle_t", """
SELECT customer_id, event_type, timestamp, days_without_order, days_inactive, channel
FROM (SELECT *, min(CASE WHEN event_type = 'CustomerChurned' THEN timestamp END)
                OVER (PARTITION BY customer_id) AS churn_ts FROM lc_cand)
WHERE churn_ts IS NULL OR timestamp <= churn_ts
""", ("lc_cand",))

cte("lc_all", """
SELECT customer_id, 'CustomerCreated' AS event_type, created_at AS timestamp,
       CAST(NULL AS INTEGER) AS days_without_order FROM cust
UNION ALL
SELECT customer_id, event_type, timestamp, days_without_order FROM lifecycle_t
""", ("cust", "lifecycle_t"))

cte("customers_t", """
SELECT c.*, coalesce(CASE s.latest WHEN 'CustomerBecameInactive' THEN 'inactive'
                                   WHEN 'CustomerBecameDormant' THEN 'dormant'
                                   WHEN 'CustomerChurned' THEN 'churned' ELSE 'active' END, 'active') AS status
FROM cust c LEFT JOIN (SELECT customer_id, arg_max(event_type, timestamp) AS latest FROM lifecycle_t
                       GROUP BY customer_id) s ON c.customer_id = s.customer_id
""", ("cust", "lifecycle_t"))

cte("rfm_monthly", f"""
SELECT customer_id, date_trunc('month', created_at) AS month, max(created_at) AS last_order_date,
       count(total_value) AS frequency, CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) AS monetary,
       (epoch_us(CAST(last_day(date_trunc('month', created_at)) AS TIMESTAMP)) - epoch_us(max(created_at)))
         / {D_US} AS recency_raw
FROM ord GROUP BY customer_id, date_trunc('month', created_at)
""", ("ord",))

cte("rfm_base", """
SELECT customer_id, month, last_order_date, frequency, monetary,
       CAST(trunc(recency_raw) AS BIGINT) AS recency_days
FROM rfm_monthly
""", ("rfm_monthly",))

cte("rfm_breaks", """
SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS rb,
       quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS fb,
       quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mb
FROM rfm_base
""", ("rfm_base",))

cte("rfm_t", """
SELECT r.*,
       ['5', '4', '3', '2', '1'][len(list_filter(b.rb, lambda x: x < CAST(r.recency_days AS DOUBLE))) + 1] AS r_score,
       ['1', '2', '3', '4', '5'][len(list_filter(b.fb, lambda x: x < CAST(r.frequency AS DOUBLE))) + 1] AS f_score,
       ['1', '2', '3', '4', '5'][len(list_filter(b.mb, lambda x: x < r.monetary)) + 1] AS m_score
FROM rfm_base r, rfm_breaks b
""", ("rfm_base", "rfm_breaks"))

cte("rep_perf_t", """
SELECT v.rep_id, v.month, v.total_visits, v.order_visits, g.gmv
FROM (SELECT rep_id, date_trunc('month', timestamp) AS month, count(*) AS total_visits,
             count(*) FILTER (WHERE outcome <> 'no_order') AS order_visits
      FROM visits_t GROUP BY 1, 2) v
LEFT JOIN (SELECT rep_id, date_trunc('month', created_at) AS month,
                  CAST(sum(CAST(total_value AS DECIMAL(20, 2))) AS DOUBLE) AS gmv
           FROM ord WHERE rep_id IS NOT NULL GROUP BY 1, 2) g
ON v.rep_id = g.rep_id AND v.month = g.month
""", ("visits_t", "ord"))

# --- decisioning (J) -----------------------------------------------------------------------
cte("rfm_latest", """
SELECT customer_id, arg_max(r_score, month) AS rfm_r, arg_max(f_score, month) AS rfm_f,
       arg_max(m_score, month) AS rfm_m, arg_max(monetary, month) AS rfm_monetary
FROM rfm_t GROUP BY customer_id
""", ("rfm_t",))

cte("enriched", """
SELECT o.order_id, o.customer_id, o.created_at, o.status, o.channel, o.rep_id,
       coalesce(o.total_value, 0.0::DOUBLE) AS total_amount,
       coalesce(o.fraud_score, 0.5::DOUBLE) AS fraud_score,
       CASE coalesce(c.segment, 'regular') WHEN 'premium' THEN 'premium' WHEN 'regular' THEN 'standard'
            WHEN 'low_volume' THEN 'at-risk' ELSE 'standard' END AS customer_segment,
       coalesce(c.payment_method, 'cash') AS payment_method,
       coalesce(c.credit_limit, 0.0::DOUBLE) AS credit_limit,
       coalesce(c.risk_score, 0.0::DOUBLE) AS customer_risk,
       coalesce(c.customer_type, '') AS customer_type,
       coalesce(c.area_id, '') AS area_id,
       coalesce(r.rfm_r, '') AS rfm_r, coalesce(r.rfm_f, '') AS rfm_f, coalesce(r.rfm_m, '') AS rfm_m,
       coalesce(r.rfm_monetary, 0.0::DOUBLE) AS rfm_monetary,
       coalesce(r.rfm_monetary, 0.0::DOUBLE) AS avg_basket_90d
FROM orders_t o
LEFT JOIN customers_t c ON o.customer_id = c.customer_id
LEFT JOIN rfm_latest r ON o.customer_id = r.customer_id
WHERE o.order_id IS NOT NULL AND o.customer_id IS NOT NULL
""", ("orders_t", "customers_t", "rfm_latest"))

cte("factors", """
SELECT e.*,
       CASE lower(coalesce(customer_segment, 'standard')) WHEN 'premium' THEN 1.0::DOUBLE
            WHEN 'standard' THEN 0.6::DOUBLE WHEN 'at-risk' THEN 0.2::DOUBLE WHEN 'new' THEN 0.4::DOUBLE
            WHEN 'churned' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS f_ltv,
       1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE,
            CASE WHEN fraud_score IS NULL OR fraud_score = 0 THEN 0.5::DOUBLE ELSE fraud_score END)) AS f_fraud,
       CASE lower(coalesce(payment_method, 'cod')) WHEN 'credit' THEN 0.9::DOUBLE
            WHEN 'bank_transfer' THEN 0.8::DOUBLE WHEN 'direct_debit' THEN 0.8::DOUBLE
            WHEN 'cheque' THEN 0.65::DOUBLE WHEN 'cod' THEN 0.5::DOUBLE WHEN 'cash' THEN 0.45::DOUBLE
            ELSE 0.5::DOUBLE END
       * (1.0::DOUBLE - CASE WHEN avg_basket_90d > 0
              THEN least(greatest(total_amount / avg_basket_90d - 1.0::DOUBLE, 0.0::DOUBLE) / 4.0::DOUBLE, 1.0::DOUBLE)
              ELSE least(total_amount / 30000.0::DOUBLE, 1.0::DOUBLE) END * 0.3::DOUBLE) AS f_pay
FROM enriched e
""", ("enriched",))

cte("scored", """
SELECT f.*,
       0.4::DOUBLE * f_ltv + 0.35::DOUBLE * f_fraud + 0.25::DOUBLE * f_pay AS composite_raw
FROM factors f
""", ("factors",))

cte("decided", """
SELECT s.*,
       CASE WHEN composite_raw >= 0.7 THEN 'AUTO_APPROVE' WHEN composite_raw >= 0.4 THEN 'MANUAL_REVIEW'
            ELSE 'DECLINE' END AS decision,
       floor(f_ltv * 10000.0 + 0.5) / 10000.0 AS ltv_score,
       floor(f_fraud * 10000.0 + 0.5) / 10000.0 AS fraud_approval_component,
       floor(f_pay * 10000.0 + 0.5) / 10000.0 AS payment_score,
       floor(composite_raw * 10000.0 + 0.5) / 10000.0 AS decision_score,
       'v1.0' AS model_version
FROM scored s
""", ("scored",))

cte("routed", """
SELECT d.*,
       CASE decision WHEN 'AUTO_APPROVE' THEN 'FULFILLED' WHEN 'MANUAL_REVIEW' THEN 'ESCALATED'
            ELSE 'REJECTED' END AS action,
       CASE decision WHEN 'AUTO_APPROVE' THEN 'Order approved and routed to fulfillment DC'
            WHEN 'MANUAL_REVIEW' THEN concat('Order escalated to review queue — score ',
                 CAST(CAST(floor(decision_score * 1000.0 + 0.5) AS BIGINT) // 1000 AS VARCHAR), '.',
                 lpad(CAST(CAST(floor(decision_score * 1000.0 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0'))
            ELSE 'Order declined — insufficient approval score; credit team notified' END AS action_detail,
       CASE WHEN decision = 'MANUAL_REVIEW' AND decision_score < 0.55 THEN 'high'
            WHEN decision = 'MANUAL_REVIEW' THEN 'medium' ELSE 'normal' END AS priority,
       lower(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(order_id))) AS h
FROM decided d
""", ("decided",))

cte("audit_t", """
SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
              ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1],
              substr(h, 18, 3), '-', substr(h, 21, 12)) AS action_id,
       order_id, action, action_detail, priority, coalesce(decision, 'UNKNOWN') AS decision,
       coalesce(decision_score, 0.0::DOUBLE) AS composite_score, coalesce(customer_id, '') AS customer_id,
       coalesce(customer_segment, '') AS customer_segment, coalesce(total_amount, 0.0::DOUBLE) AS total_amount,
       coalesce(payment_method, '') AS payment_method
FROM routed
""", ("routed",))


# --- dunning promises (L16) and the whole log's per-type counts ------------------------------------
cte("promises_t", """
SELECT invoice_id, customer_id, total_value AS promised_amount,
       strftime(invoiced_at + to_days(CAST(base_days + 7 AS INTEGER)), '%Y-%m-%d') AS promise_date,
       invoiced_at + to_days(CAST(base_days AS INTEGER)) AS timestamp, orderkey % 10 IN (7, 8) AS kept
FROM delivered WHERE orderkey % 10 >= 7
""", ("delivered",))

cte("type_counts", """
SELECT 'CustomerCreated' AS event_type, count(*) AS n FROM customer
UNION ALL SELECT 'OrderCreated', count(*) FROM orders
UNION ALL SELECT 'OrderShipped', count(*) FROM ord WHERE orderstatus IN ('O', 'F')
UNION ALL SELECT 'OrderDelivered', count(*) FROM ord WHERE orderstatus = 'F'
UNION ALL SELECT 'OrderReturned', count(*) FROM ord WHERE orderstatus = 'F' AND orderkey % 20 = 0
UNION ALL SELECT 'OrderCancelled', count(*) FROM ord WHERE orderstatus = 'P' AND orderkey % 25 = 0
UNION ALL SELECT 'InvoiceCreated', count(*) FROM invoices_t
UNION ALL SELECT 'PaymentCaptured', count(*) FROM payments_t WHERE status = 'paid'
UNION ALL SELECT 'PaymentFailed', count(*) FROM payments_t WHERE status = 'failed'
UNION ALL SELECT 'CreditWrittenOff', count(*) FROM writeoffs_t
UNION ALL SELECT 'CollectionScheduled', count(*) FROM promises_t
UNION ALL SELECT 'CollectionPromiseMade', count(*) FROM promises_t
UNION ALL SELECT 'PurchaseOrderCreated', count(*) FROM stock_po
UNION ALL SELECT 'StockReceived', count(*) FROM stock_po
UNION ALL SELECT 'StockReserved', count(*) FROM lines WHERE l_linestatus = 'F'
UNION ALL SELECT 'StockReleased', count(*) FROM lines
          WHERE l_linestatus = 'F' AND orderstatus = 'P' AND l_orderkey % 25 = 0
UNION ALL SELECT 'StockoutOccurred', count(*) FROM stockouts_t
UNION ALL SELECT 'PromotionApplied', count(*) FROM promo_applied
UNION ALL SELECT 'RepVisitCompleted', count(*) FROM events WHERE event_type = 'view'
UNION ALL SELECT 'AppSessionEvent', count(*) FROM events WHERE event_type IN ('signup', 'click', 'purchase')
UNION ALL SELECT 'AppError', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT event_type, count(*) FROM lifecycle_t GROUP BY event_type
""", ("ord", "invoices_t", "payments_t", "writeoffs_t", "promises_t", "stock_po", "lines", "stockouts_t",
      "promo_applied", "lifecycle_t"))

cte("total_events", "SELECT CAST(sum(n) AS BIGINT) AS n FROM type_counts", ("type_counts",))
