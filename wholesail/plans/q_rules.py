"""Registered queries: re-aimed simulator rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import credit as CR
from ..operators import features as L
from ..operators import inventory as INV
from ..operators import projections as P
from ..operators import promotions as PR
from ..sources.adapter import replenishment
from ..sources.eventlog import read_events, typed
from .oracle import _CTES, D_US, cte, sql
from .q_projections import log_of, tables_of
from .registry import query

FRAUD_SCORE_SQL = """least(1.0::DOUBLE,
   CASE WHEN {v} >= 3 THEN least(1.0::DOUBLE, 0.4::DOUBLE + ({v} - 3) * 0.1::DOUBLE) ELSE 0.0::DOUBLE END * 0.5::DOUBLE
 + CASE WHEN {avg} > 0 AND {val} > {avg} * 5.0::DOUBLE
        THEN least(1.0::DOUBLE, 0.3::DOUBLE + ({val} / ({avg} * 5.0::DOUBLE) - 1) * 0.2::DOUBLE)
        ELSE 0.0::DOUBLE END * 0.4::DOUBLE
 + ({risk} * 0.3::DOUBLE) * 0.1::DOUBLE)"""


def lines_with_time(log, *fields):
    """Order lines with their order's timestamp (OrderCreated payload, inlined), or only ``fields`` of theirs."""
    o = typed(log, "OrderCreated", ["order_id", "lines"])
    if not fields:
        return o.select("order_id", "timestamp", F.inline("lines"))
    own = F.arrays_zip(*[F.col("lines")[f] for f in fields])  # of stored columns, no other field is read
    return o.select("order_id", "timestamp", F.inline(own)).toDF("order_id", "timestamp", *fields)


# --- L1–L3 -----------------------------------------------------------------------------------------
cte("feat_o", "SELECT order_id, customer_id, created_at, total_value FROM orders_t", ("orders_t",))
cte("feat_vel", """
SELECT a.order_id, count(b.order_id) AS velocity_24h
FROM feat_o a
LEFT JOIN feat_o b ON a.customer_id = b.customer_id AND b.created_at >= a.created_at - INTERVAL 24 HOUR
                  AND b.created_at < a.created_at
GROUP BY a.order_id""", ("feat_o",))
cte("feat_m90", """
SELECT a.order_id,
       CASE WHEN count(b.order_id) > 0
            THEN CAST(sum(CAST(b.total_value AS DECIMAL(20, 2))) AS DOUBLE) / count(b.order_id)
            ELSE 0.0::DOUBLE END AS mean_90d
FROM feat_o a
LEFT JOIN feat_o b ON a.customer_id = b.customer_id AND b.created_at >= a.created_at - INTERVAL 90 DAY
                  AND b.created_at < a.created_at
GROUP BY a.order_id""", ("feat_o",))
cte("feat_prev", """
SELECT order_id,
       CASE WHEN count(*) OVER w > 0
            THEN CAST(sum(CAST(total_value AS DECIMAL(20, 2))) OVER w AS DOUBLE) / count(*) OVER w
            ELSE 0.0::DOUBLE END AS avg_prev
FROM feat_o
WINDOW w AS (PARTITION BY customer_id ORDER BY created_at, order_id ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)
""", ("feat_o",))


@query("order_fraud_features", sql(f"""
SELECT o.order_id, o.customer_id, v.velocity_24h, p.avg_prev, m.mean_90d,
       {FRAUD_SCORE_SQL.format(v='v.velocity_24h', avg='p.avg_prev', val='o.total_value',
                               risk='coalesce(c.risk_score, 0.0::DOUBLE)')} AS fraud_model_score
FROM feat_o o JOIN feat_vel v ON o.order_id = v.order_id JOIN feat_prev p ON o.order_id = p.order_id
JOIN feat_m90 m ON o.order_id = m.order_id LEFT JOIN cust c ON o.customer_id = c.customer_id""",
    "feat_o", "feat_vel", "feat_prev", "feat_m90", "cust"), "L1 L2 L3 F3 F4 T10")
def q_fraud_features(spark, d):
    return L.order_features(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


@query("fraud_velocity_windows", sql(f"""
SELECT w.customer_id, w.window_start, w.window_start + INTERVAL 24 HOUR AS window_end, w.orders,
       {FRAUD_SCORE_SQL.format(v='w.orders', avg='1.0::DOUBLE', val='1.0::DOUBLE',
                               risk='coalesce(c.risk_score, 0.0::DOUBLE)')} AS score,
       CAST(NULL AS VARCHAR) AS action,
       CASE WHEN w.orders >= 3 THEN 'velocity' ELSE 'amount_spike' END AS fraud_type
FROM (SELECT o.customer_id,
             make_timestamp((epoch_us(o.created_at) // 21600000000 - k.k) * 21600000000) AS window_start,
             count(*) AS orders
      FROM orders_t o, (SELECT unnest([0, 1, 2, 3]) AS k) k GROUP BY 1, 2) w
LEFT JOIN cust c ON w.customer_id = c.customer_id""", "orders_t", "cust"), "L4 M6")
def q_fraud_windows(spark, d):
    return L.fraud_windows(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"])


# --- L8, L18–L21 ---------------------------------------------------------------------------------
cte("lift_oc", "SELECT DISTINCT order_id, demand_class FROM lines", ("lines",))


@query("category_lift", sql("""
SELECT p.cat_a, p.cat_b, p.both, sa.c AS n_a, sb.c AS n_b,
       (CAST(p.both AS DOUBLE) * n.n) / (CAST(sa.c AS DOUBLE) * sb.c) AS lift
FROM (SELECT a.demand_class AS cat_a, b.demand_class AS cat_b, count(*) AS both
      FROM lift_oc a JOIN lift_oc b ON a.order_id = b.order_id AND a.demand_class < b.demand_class GROUP BY 1, 2) p
JOIN (SELECT demand_class, count(*) AS c FROM lift_oc GROUP BY demand_class) sa ON p.cat_a = sa.demand_class
JOIN (SELECT demand_class, count(*) AS c FROM lift_oc GROUP BY demand_class) sb ON p.cat_b = sb.demand_class,
     (SELECT count(DISTINCT order_id) AS n FROM lift_oc) n""", "lift_oc"), "L8")
def q_category_lift(spark, d):
    return L.category_lift(tables_of(spark, d)["order_lines"])


@query("session_funnel", sql("""
SELECT session_id, customer_id, count(*) AS events,
       count(*) FILTER (WHERE event_subtype = 'screen_view') AS views,
       count(*) FILTER (WHERE event_subtype = 'product_search') AS searches,
       CAST(sum(session_duration_seconds) AS BIGINT) AS duration_seconds,
       bool_or(led_to_order) AS led_to_order, min(timestamp) AS started_at
FROM app_t GROUP BY session_id, customer_id""", "app_t"), "L18")
def q_funnel(spark, d):
    return L.session_funnel(typed(log_of(spark, d), "AppSessionEvent"))


@query("visit_outcome_mix", sql("""
SELECT coalesce(c.segment, 'unknown') AS segment, v.outcome, count(*) AS visits
FROM visits_t v LEFT JOIN cust c ON v.customer_id = c.customer_id GROUP BY 1, 2""", "visits_t", "cust"), "L19")
def q_visit_mix(spark, d):
    log = log_of(spark, d)
    return L.visit_outcome_mix(typed(log, "RepVisitCompleted"), tables_of(spark, d)["customers"])


@query("visit_gaps", sql(f"""
SELECT event_id, rep_id, customer_id, timestamp, outcome, days_since_last, days_since_last > 30 AS overdue
FROM (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY rep_id, customer_id
                                                                   ORDER BY timestamp, event_id)))
                / {float(D_US)} AS days_since_last FROM visits_t)""", "visits_t"), "L19")
def q_visit_gaps(spark, d):
    return L.visit_gaps(typed(log_of(spark, d), "RepVisitCompleted"))


@query("channel_attribution", sql("""
SELECT o.order_id, o.customer_id, o.channel, count(v.customer_id) AS visits_7d,
       CASE WHEN count(v.customer_id) > 0 THEN 'rep' ELSE o.channel END AS attributed_channel
FROM orders_t o LEFT JOIN visits_t v ON v.customer_id = o.customer_id
     AND v.timestamp >= o.created_at - INTERVAL 7 DAY AND v.timestamp <= o.created_at
GROUP BY o.order_id, o.customer_id, o.channel""", "orders_t", "visits_t"), "L21 D10")
def q_attribution(spark, d):
    log = log_of(spark, d)
    return L.channel_attribution(tables_of(spark, d)["orders"], typed(log, "RepVisitCompleted"))


cte("prop_f", f"""
SELECT c.customer_id, c.segment,
       coalesce((epoch_us(a.as_of) - epoch_us(l.last_order)) / {float(D_US)}, 9999.0::DOUBLE) AS days,
       CASE c.segment WHEN 'premium' THEN 0.12::DOUBLE WHEN 'regular' THEN 0.07::DOUBLE
            WHEN 'low_volume' THEN 0.02::DOUBLE WHEN 'new_30d' THEN 0.15::DOUBLE ELSE 0.07::DOUBLE END AS base,
       [0.85, 0.90, 1.20, 1.30, 1.00, 1.20, 1.40, 1.45, 1.30, 1.05, 0.95, 1.00][month(a.as_of)]::DOUBLE AS season,
       EXISTS (SELECT 1 FROM visits_t v WHERE v.customer_id = c.customer_id AND v.rep_id = c.rep_id
               AND v.timestamp <= a.as_of AND v.timestamp >= a.as_of - INTERVAL 7 DAY) AS visited,
       EXISTS (SELECT 1 FROM lifecycle_t y WHERE y.customer_id = c.customer_id AND y.event_type = 'CustomerReactivated'
               AND y.timestamp <= a.as_of AND y.timestamp >= a.as_of - INTERVAL 30 DAY) AS back
FROM cust c
LEFT JOIN (SELECT customer_id, max(created_at) AS last_order FROM orders_t GROUP BY customer_id) l
       ON c.customer_id = l.customer_id,
     (SELECT max(created_at) AS as_of FROM orders_t) a
""", ("cust", "orders_t", "visits_t", "lifecycle_t"))


@query("order_propensity", sql("""
SELECT customer_id, segment, days AS days_since_order,
       round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(base * CASE WHEN days < 7 THEN 1.2::DOUBLE
                                                             WHEN days > 60 THEN 0.1::DOUBLE
                                                             WHEN days > 30 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
                                                 * CASE WHEN back THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * season
                                                 + CASE WHEN segment = 'low_volume' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
                                                 + CASE WHEN visited THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END))), 9) AS p_order
FROM prop_f""", "prop_f"), "L20")
def q_propensity(spark, d):
    log = log_of(spark, d)
    o = tables_of(spark, d)["orders"]
    as_of = o.agg(F.max("created_at").alias("as_of"))
    visits = typed(log, "RepVisitCompleted", ["rep_id", "customer_id"])
    back = tables_of(spark, d)["customer_history"].filter(F.col("event_type") == "CustomerReactivated")
    p = L.order_propensity(tables_of(spark, d)["customers"], o, as_of, promo_segments=["low_volume"], visits=visits,
                           reactivations=back)
    return p.select("customer_id", "segment", "days_since_order", F.round("p_order", 9).alias("p_order"))


@query("payment_success_tiers", sql("""
SELECT CASE WHEN risk_score < 0.3 THEN 0.95::DOUBLE WHEN risk_score < 0.7 THEN 0.70::DOUBLE ELSE 0.40::DOUBLE END
         AS success_probability, count(*) AS customers
FROM cust GROUP BY 1""", "cust"), "L14")
def q_tiers(spark, d):
    c = tables_of(spark, d)["customers"]
    return c.groupBy(L.payment_success_probability(F.col("risk_score")).alias("success_probability")).agg(
        F.count(F.lit(1)).alias("customers"))


# --- L17 -----------------------------------------------------------------------------------------
cte("px_daily", """
SELECT CAST(created_at AS DATE) AS day,
       CAST(sum(CAST(line_total AS DECIMAL(20, 2))) AS DOUBLE) / sum(quantity) AS avg_price
FROM lines GROUP BY 1""", ("lines",))


@query("price_index", sql("""
SELECT strftime(day, '%Y-%m-%d') AS day, round(delta, 9) AS delta, round(exp(sum(ln(1 + delta)) OVER (ORDER BY day
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS "index"
FROM (SELECT day, coalesce(avg_price / lag(avg_price) OVER (ORDER BY day) - 1, 0.0::DOUBLE) AS delta
      FROM px_daily)""", "px_daily"), "L17")
def q_price_index(spark, d):
    li = lines_with_time(log_of(spark, d))
    daily = li.groupBy(F.to_date("timestamp").alias("day")).agg(
        (F.sum(P.money("line_total")).cast("double") / F.sum("quantity")).alias("avg_price"))
    w = Window.orderBy("day")  # one row per calendar day
    delta = F.coalesce(F.col("avg_price") / F.lag("avg_price").over(w) - 1, F.lit(0.0))
    idx = L.price_index(daily.select("day", delta.alias("delta")))
    return idx.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("delta", 9).alias("delta"),
                      F.round("index", 6).alias("index"))


# --- L4: alerts among bursts ---------------------------------------------------------------------
cte("burst_o", """
SELECT order_id, concat('B-', strftime(created_at, '%Y%m')) AS customer_id,
       make_timestamp(epoch_us(date_trunc('month', created_at)) + (epoch_us(created_at) - epoch_us(date_trunc('month', created_at))) // 8) AS created_at,
       CASE WHEN k % 40 = 0 THEN round(total_value * (10 + k % 50), 2) ELSE total_value END AS total_value
FROM (SELECT *, CAST(split_part(order_id, '-', 2) AS BIGINT) AS k FROM orders_t)""", ("orders_t",))
for _name in ("feat_vel", "feat_prev"):
    cte(f"{_name}_b", _CTES[_name][0].replace("feat_o", "burst_o"), ("burst_o",))


def burst_orders(orders):
    """The orders of a month as those of one buyer within its first days, one in 40 of many times its value."""
    k = F.substring_index("order_id", "-", -1).cast("long")
    month = F.unix_micros(F.date_trunc("month", "created_at"))
    at = F.timestamp_micros(month + F.floor((F.unix_micros("created_at") - month) / 8).cast("long"))
    value = F.when(k % 40 == 0, F.round(F.col("total_value") * (F.lit(10) + k % 50), 2)).otherwise(F.col("total_value"))
    return orders.select("order_id", F.concat(F.lit("B-"), F.date_format("created_at", "yyyyMM")).alias("customer_id"), at.alias("created_at"), value.alias("total_value"))


@query("fraud_alerts", sql(f"""
SELECT order_id, customer_id, round(s, 4) AS fraud_score, CASE WHEN s >= 0.9 THEN 'rejected' ELSE 'flagged' END AS action,
       CASE WHEN velocity_24h >= 3 THEN 'velocity' ELSE 'amount_spike' END AS fraud_type
FROM (SELECT o.order_id, o.customer_id, v.velocity_24h,
             {FRAUD_SCORE_SQL.format(v='v.velocity_24h', avg='p.avg_prev', val='o.total_value', risk='0.0::DOUBLE')} AS s
      FROM burst_o o JOIN feat_vel_b v ON o.order_id = v.order_id JOIN feat_prev_b p ON o.order_id = p.order_id)
WHERE s >= 0.8""", "burst_o", "feat_vel_b", "feat_prev_b"), "L4")
def q_fraud_alerts(spark, d):
    t = tables_of(spark, d)
    return L.fraud_alerts(L.order_features(burst_orders(t["orders"]), t["customers"]))


# --- L5–L7, L12, L13, L22 ------------------------------------------------------------------------
cte("inv_st", """
SELECT s.sku_id, CAST(s.sx AS DOUBLE) / n.n AS avg_daily_demand,
       sqrt(greatest(CAST(n.n * s.sxx - s.sx * s.sx AS DOUBLE) / CAST(n.n * (n.n - 1) AS DOUBLE), 0.0::DOUBLE))
         AS demand_std
FROM (SELECT sku_id, sum(q) AS sx, sum(q * q) AS sxx
      FROM (SELECT sku_id, CAST(created_at AS DATE) AS day, sum(quantity) AS q FROM lines GROUP BY 1, 2)
      GROUP BY sku_id) s,
     (SELECT datediff('day', min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE))) + 1 AS n FROM lines) n
""", ("lines",))

cte("inv_pol", """
SELECT st.sku_id, st.avg_daily_demand, st.demand_std,
       coalesce(CAST(p.lead AS DOUBLE), 7.0::DOUBLE) AS lead_time_days,
       coalesce(CAST(i.estimated_on_hand AS DOUBLE), 0.0::DOUBLE) AS on_hand
FROM inv_st st
LEFT JOIN (SELECT sku_id, max(expected_lead_time_days) AS lead_time_days, max(expected_lead_time_days) AS lead
           FROM stock_po GROUP BY sku_id) p ON st.sku_id = p.sku_id
LEFT JOIN inventory_t i ON st.sku_id = i.sku_id
""", ("inv_st", "stock_po", "inventory_t"))

cte("inv_calc", """
SELECT *, 1.645::DOUBLE * sqrt(lead_time_days) * demand_std AS safety_stock,
       avg_daily_demand * lead_time_days + 1.645::DOUBLE * sqrt(lead_time_days) * demand_std AS reorder_point,
       CASE WHEN avg_daily_demand * 365.0::DOUBLE <= 0 THEN CAST(50 AS BIGINT)
            ELSE greatest(CAST(1 AS BIGINT), CAST(floor(sqrt(2.0::DOUBLE * (avg_daily_demand * 365.0::DOUBLE)
                                                           * 200.0::DOUBLE / 10.0::DOUBLE)) AS BIGINT)) END AS eoq
FROM inv_pol
""", ("inv_pol",))


@query("inventory_policy", sql("""
SELECT sku_id, avg_daily_demand, demand_std, lead_time_days, safety_stock, reorder_point, eoq, on_hand,
       greatest(CAST(1 AS BIGINT), CAST(ceil(greatest(CAST(eoq AS DOUBLE),
                                                 reorder_point - (on_hand + 0.0::DOUBLE) + safety_stock)) AS BIGINT))
         AS order_quantity,
       on_hand <= reorder_point AND 0.0 <= 0 AS reorder
FROM inv_calc""", "inv_calc"), "L5 L6")
def q_inventory_policy(spark, d):
    log = log_of(spark, d)
    li = lines_with_time(log)
    lead = typed(log, "PurchaseOrderCreated", ["sku_id", "expected_lead_time_days"]).groupBy("sku_id").agg(
        F.max("expected_lead_time_days").alias("lead_time_days"))
    return INV.inventory_policy(li, F.to_date("timestamp"), lead, tables_of(spark, d)["inventory_snapshot"])


@query("elastic_quantities", sql("""
SELECT demand_class, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS base_qty,
       CAST(sum(greatest(1, CAST(round_even(quantity * (1.0::DOUBLE
            + CASE demand_class WHEN 'A' THEN -0.3::DOUBLE WHEN 'B' THEN -0.6::DOUBLE WHEN 'C' THEN -1.2::DOUBLE
                   ELSE -0.6::DOUBLE END * (-(discount_amount / line_total))), 0) AS BIGINT))) AS BIGINT) AS adjusted_qty
FROM lines GROUP BY demand_class""", "lines"), "L7")
def q_elastic(spark, d):
    li = lines_with_time(log_of(spark, d))
    adj = INV.elastic_quantity(F.col("quantity"), -(F.col("discount_amount") / F.col("line_total")), F.col("demand_class"))
    return li.groupBy("demand_class").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("base_qty"),
        F.sum(adj).cast("long").alias("adjusted_qty"))


cte("alloc_ev", """
SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY timestamp, k, ref, quantity) AS rn FROM (
  SELECT sku_id, received_at AS timestamp, 'receipt' AS kind, purchase_order_id AS ref, quantity, 0 AS k FROM stock_po
  UNION ALL SELECT sku_id, created_at, 'demand', order_id, quantity, 1 FROM lines)""", ("stock_po", "lines"))
cte("alloc_walk", """
SELECT sku_id, rn, timestamp, kind, ref, quantity, CASE WHEN kind = 'demand' THEN 0 >= quantity END AS reserved,
       CAST(0 AS BIGINT) AS available_before,
       CASE WHEN kind = 'receipt' THEN quantity WHEN 0 >= quantity THEN -quantity ELSE 0 END AS level_after
FROM alloc_ev WHERE rn = 1
UNION ALL
SELECT e.sku_id, e.rn, e.timestamp, e.kind, e.ref, e.quantity,
       CASE WHEN e.kind = 'demand' THEN w.level_after >= e.quantity END, w.level_after,
       CASE WHEN e.kind = 'receipt' THEN w.level_after + e.quantity
            WHEN w.level_after >= e.quantity THEN w.level_after - e.quantity ELSE w.level_after END
FROM alloc_walk w JOIN alloc_ev e ON e.sku_id = w.sku_id AND e.rn = w.rn + 1""", ("alloc_ev",))


@query("stock_allocation", sql("""
SELECT sku_id, timestamp, kind, ref, quantity, reserved, available_before, CAST(level_after AS BIGINT) AS level_after
FROM alloc_walk""", "alloc_walk", recursive=True), "L12")
def q_allocation(spark, d):
    log = log_of(spark, d, "OrderCreated", "StockReceived", decoded=True)
    receipts = typed(log, "StockReceived").select("sku_id", "timestamp", F.col("purchase_order_id").alias("ref"),
                                                  "quantity")
    demand = lines_with_time(log, "sku_id", "quantity").select("sku_id", "timestamp", F.col("order_id").alias("ref"), "quantity")
    return INV.allocate(receipts, demand)


cte("bo_need", """
SELECT sku_id, timestamp, order_id, requested_quantity - available_quantity AS shortfall
FROM stockouts_t WHERE resolution = 'backorder' AND requested_quantity > available_quantity""", ("stockouts_t",))
cte("bo_po", """
SELECT sku_id, concat('RPO-', pk, '-', strftime(month, '%Y%m')) AS ref, month + INTERVAL 1 MONTH AS po_at,
       month + INTERVAL 1 MONTH + to_days(CAST(7 + pk % 14 + pk % 5 AS INTEGER)) AS received_at, open * 4 // 5 + 1 AS quantity
FROM (SELECT sku_id, CAST(split_part(sku_id, '-', 2) AS BIGINT) AS pk, date_trunc('month', timestamp) AS month, CAST(sum(shortfall) AS BIGINT) AS open
      FROM bo_need GROUP BY ALL)""", ("bo_need",))
cte("bo_ev", """
SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY timestamp, k, ref, n) AS rn FROM (
  SELECT sku_id, timestamp, 1 AS k, order_id AS ref, shortfall AS n FROM bo_need
  UNION ALL SELECT sku_id, received_at, 0, ref, quantity FROM bo_po
  UNION ALL SELECT sku_id, received_at, 0, purchase_order_id, quantity FROM stock_po
  UNION ALL SELECT sku_id, created_at + INTERVAL 1 HOUR, 0, order_id, quantity FROM lines
            WHERE l_linestatus = 'F' AND orderstatus = 'P' AND l_orderkey % 25 = 0)""", ("bo_need", "bo_po", "stock_po", "lines"))
cte("bo_walk", """
SELECT sku_id, rn, timestamp, k, ref, n, CASE WHEN k = 1 THEN n ELSE CAST(0 AS BIGINT) END AS waiting, CAST(0 AS BIGINT) AS served
FROM bo_ev WHERE rn = 1
UNION ALL
SELECT e.sku_id, e.rn, e.timestamp, e.k, e.ref, e.n, CASE WHEN e.k = 1 THEN w.waiting + e.n ELSE w.waiting - least(w.waiting, e.n) END,
       CASE WHEN e.k = 0 THEN least(w.waiting, e.n) ELSE 0 END
FROM bo_walk w JOIN bo_ev e ON e.sku_id = w.sku_id AND e.rn = w.rn + 1""", ("bo_ev",))


@query("backorder_fulfilment", sql("""
SELECT d.sku_id, d.ref AS order_id, d.timestamp, d.n AS shortfall,
       CAST(least(d.hi, f.hi) - greatest(d.hi - d.n, f.hi - f.served) AS BIGINT) AS quantity, f.timestamp AS fulfilled_at, f.ref
FROM (SELECT *, sum(n) OVER (PARTITION BY sku_id ORDER BY rn) AS hi FROM bo_walk WHERE k = 1) d
JOIN (SELECT *, sum(served) OVER (PARTITION BY sku_id ORDER BY rn) AS hi FROM bo_walk WHERE served > 0) f
  ON f.sku_id = d.sku_id AND least(d.hi, f.hi) > greatest(d.hi - d.n, f.hi - f.served)
UNION ALL
SELECT d.sku_id, d.ref, d.timestamp, d.n, CAST(least(d.n, d.hi - coalesce(s.served, 0)) AS BIGINT), NULL, NULL
FROM (SELECT *, sum(n) OVER (PARTITION BY sku_id ORDER BY rn) AS hi FROM bo_walk WHERE k = 1) d
LEFT JOIN (SELECT sku_id, sum(served) AS served FROM bo_walk GROUP BY sku_id) s ON s.sku_id = d.sku_id
WHERE d.hi > coalesce(s.served, 0)""", "bo_walk", recursive=True), "L13")
def q_backorders(spark, d):
    log = log_of(spark, d)
    need = open_backorders(spark, d)
    received = typed(log, "StockReceived").select("sku_id", "timestamp", F.col("purchase_order_id").alias("ref"), "quantity")
    released = typed(log, "StockReleased").select("sku_id", "timestamp", F.col("order_id").alias("ref"), "quantity")
    again = replenishment(need).select("sku_id", F.col("received_at").alias("timestamp"), "ref", "quantity")
    return INV.backorder_fulfilment(need, received.unionByName(released).unionByName(again))


def open_backorders(spark, d):
    short = F.col("requested_quantity") - F.col("available_quantity")
    s = tables_of(spark, d)["stockout_events"].filter("resolution = 'backorder'")
    return s.select("sku_id", "timestamp", "order_id", short.cast("long").alias("shortfall")).filter("shortfall > 0")


@query("reorder_signals", sql("""
SELECT sku_id, available, on_order, reorder_point, available <= reorder_point AND on_order <= 0 AS reorder,
       greatest(CAST(1 AS BIGINT), CAST(ceil(greatest(CAST(eoq AS DOUBLE), reorder_point - (available + on_order) + safety_stock)) AS BIGINT)) AS order_quantity
FROM (SELECT c.*, c.on_hand - coalesce(o.q, 0) AS available, coalesce(p.q, 0)::DOUBLE AS on_order
      FROM inv_calc c
      LEFT JOIN (SELECT sku_id, sum(quantity) AS q FROM lines WHERE l_linestatus = 'O' GROUP BY sku_id) o ON o.sku_id = c.sku_id
      LEFT JOIN (SELECT sku_id, sum(quantity) AS q FROM bo_po, (SELECT max(created_at) AS now FROM ord)
                 WHERE po_at <= now AND received_at > now GROUP BY sku_id) p ON p.sku_id = c.sku_id)""", "inv_calc", "bo_po", "lines", "ord"), "L6")
def q_reorder(spark, d):
    """L6 with stock that open lines have claimed and with purchase orders that are under way."""
    log = log_of(spark, d)
    li = lines_with_time(log)
    lead = typed(log, "PurchaseOrderCreated", ["sku_id", "expected_lead_time_days"]).groupBy("sku_id").agg(
        F.max("expected_lead_time_days").alias("lead_time_days"))
    reserved = typed(log, "StockReserved", ["sku_id", "order_id", "quantity"]).groupBy("sku_id").agg(F.sum("quantity").alias("r"))
    claimed = li.groupBy("sku_id").agg(F.sum("quantity").alias("q")).join(reserved, "sku_id", "left")
    claimed = claimed.select("sku_id", (F.col("q") - F.coalesce("r", F.lit(0))).alias("claimed"))
    stock = tables_of(spark, d)["inventory_snapshot"].join(claimed, "sku_id", "left")
    stock = stock.withColumn("estimated_on_hand", F.col("estimated_on_hand") - F.coalesce("claimed", F.lit(0)))
    now = tables_of(spark, d)["orders"].agg(F.max("created_at").alias("now"))
    under_way = INV.open_orders(replenishment(open_backorders(spark, d)), now)
    p = INV.inventory_policy(li, F.to_date("timestamp"), lead, stock, under_way).join(under_way, "sku_id", "left")
    on_order = F.coalesce("on_order", F.lit(0)).cast("double").alias("on_order")
    return p.select("sku_id", F.col("on_hand").alias("available"), on_order, "reorder_point", "reorder", "order_quantity")


cte("daily_moves", """
SELECT sku_id, CAST(received_at AS DATE) AS day, quantity AS received, 0 AS reserved FROM stock_po
UNION ALL SELECT sku_id, CAST(created_at AS DATE), 0, quantity FROM lines WHERE l_linestatus = 'F'
UNION ALL SELECT sku_id, CAST(created_at + INTERVAL 1 HOUR AS DATE), 0, -quantity FROM lines
          WHERE l_linestatus = 'F' AND orderstatus = 'P' AND l_orderkey % 25 = 0""", ("stock_po", "lines"))
cte("daily_asked", """
SELECT sku_id, CAST(day AS DATE) AS day FROM (SELECT DISTINCT sku_id FROM stock_po),
  (SELECT unnest(generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) + INTERVAL 14 DAY AS day)""", ("stock_po",))


@query("daily_inventory", sql("""
SELECT a.sku_id, strftime(a.day, '%Y-%m-%d') AS day, CAST(coalesce(m.received, 0) AS BIGINT) AS on_hand, CAST(coalesce(m.reserved, 0) AS BIGINT) AS reserved,
       CAST(coalesce(m.received - m.reserved, 0) AS BIGINT) AS available, coalesce(s.n, 0) AS stockouts, coalesce(s.n, 0) > 0 AS stockout
FROM daily_asked a
LEFT JOIN (SELECT a.sku_id, a.day, sum(m.received) AS received, sum(m.reserved) AS reserved
           FROM daily_asked a JOIN daily_moves m ON m.sku_id = a.sku_id AND m.day <= a.day GROUP BY ALL) m ON m.sku_id = a.sku_id AND m.day = a.day
LEFT JOIN (SELECT sku_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM stockouts_t GROUP BY ALL) s ON s.sku_id = a.sku_id AND s.day = a.day""",
    "daily_asked", "daily_moves", "stockouts_t"), "N D10")
def q_daily_inventory(spark, d):
    """Every SKU's stock at the end of the fifteenth of each month, also before its first receipt."""
    log = log_of(spark, d, "StockReceived", "StockReserved", "StockReleased")
    moves = None
    for kind, column in (("StockReceived", "received"), ("StockReserved", "reserved"), ("StockReleased", "released")):
        part = typed(log, kind, ["sku_id", "quantity"]).select("sku_id", "timestamp", F.col("quantity").alias(column))
        moves = part if moves is None else moves.unionByName(part, allowMissingColumns=True)
    days = F.expr("sequence(date'1994-11-15', date'1998-12-15', interval 1 month)").alias("day")
    asked = tables_of(spark, d)["inventory_snapshot"].select("sku_id", days)
    days = INV.stock_on_days(INV.stock_intervals(moves), asked, tables_of(spark, d)["stockout_events"])
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("supplier_lead_times", sql(f"""
SELECT supplier_id, count(*) AS purchase_orders, sum(lead) / count(lead) AS avg_lead_days,
       sum(lead - expected_lead_time_days) / count(lead) AS avg_delay_days,
       max(lead - expected_lead_time_days) AS max_delay_days
FROM (SELECT supplier_id, expected_lead_time_days,
             (epoch_us(received_at) - epoch_us(po_at)) / {float(D_US)} AS lead FROM stock_po)
GROUP BY supplier_id""", "stock_po"), "L22")
def q_lead_times(spark, d):
    log = log_of(spark, d)
    return INV.supplier_lead_times(typed(log, "PurchaseOrderCreated"), typed(log, "StockReceived"))


# --- L9, L11, L15 -----------------------------------------------------------------------------------
cte("promo_cal", r"""
SELECT promotion_id, CAST(regexp_extract(promotion_id, '(\d+)$', 1) AS DOUBLE) AS value,
       CAST(min(timestamp) AS DATE) AS start_day, CAST(max(timestamp) AS DATE) AS end_day
FROM promo_applied GROUP BY promotion_id""", ("promo_applied",))


@query("best_promotion", sql("""
SELECT o.order_id, b.pid AS promotion_id, coalesce(b.d, 0.0::DOUBLE) AS discount_amount,
       o.total_value - coalesce(b.d, 0.0::DOUBLE) AS discounted_total,
       o.total_value - coalesce(b.d, 0.0::DOUBLE) <= 0 AS rejected
FROM orders_t o LEFT JOIN (
  SELECT order_id, arg_min(promotion_id, {'nd': -d, 'id': promotion_id}) AS pid, max(d) AS d FROM (
    SELECT o.order_id, p.promotion_id,
           greatest(0.0::DOUBLE, o.total_value - greatest(0.0::DOUBLE,
                    o.total_value * (1.0::DOUBLE - p.value / 100.0::DOUBLE))) AS d
    FROM orders_t o JOIN promo_cal p
      ON CAST(o.created_at AS DATE) >= p.start_day AND CAST(o.created_at AS DATE) <= p.end_day)
  WHERE d > 0 GROUP BY order_id) b ON o.order_id = b.order_id""", "orders_t", "promo_cal"), "L9 D11 F12")
def q_best_promotion(spark, d):
    log = log_of(spark, d)
    cal = PR.promotion_calendar(typed(log, "PromotionApplied", ["promotion_id"]))
    return PR.best_promotion(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"], cal)


cte("scoped_rules", """
SELECT promotion_id, CAST(n AS INTEGER) AS n, ['percentage', 'fixed', 'bogo', 'percentage'][CAST(n AS INTEGER) % 4 + 1] AS promotion_type,
       CASE WHEN CAST(n AS INTEGER) % 4 = 1 THEN n * 20000 ELSE n END AS value, start_day, end_day
FROM (SELECT *, value AS n FROM promo_cal)""", ("promo_cal",))
cte("scoped_facts", """
SELECT o.order_id, o.total_value, CAST(o.created_at AS DATE) AS day, c.segment, o.channel, c.payment_method
FROM orders_t o LEFT JOIN customers_t c USING (customer_id)""", ("orders_t", "customers_t"))
cte("scoped_fit", """
SELECT f.order_id, p.promotion_id, p.promotion_type,
       greatest(0.0::DOUBLE, f.total_value - CASE p.promotion_type WHEN 'percentage' THEN greatest(0.0::DOUBLE, f.total_value * (1.0::DOUBLE - p.value / 100.0::DOUBLE))
                WHEN 'fixed' THEN greatest(0.0::DOUBLE, f.total_value - p.value) ELSE f.total_value * 0.5::DOUBLE END) AS d
FROM scoped_facts f JOIN scoped_rules p ON f.day BETWEEN p.start_day AND p.end_day
WHERE (n % 2 <> 0 OR f.segment IN ('premium', 'regular')) AND (n % 3 <> 0 OR f.channel IN ('app', 'rep'))
  AND (n % 5 <> 0 OR f.payment_method = 'credit')""", ("scoped_facts", "scoped_rules"))
cte("scoped_best", """
SELECT order_id, count(*) AS fitting,
       arg_min({'id': promotion_id, 't': promotion_type, 'd': d}, {'nd': -d, 'id': promotion_id}) FILTER (d > 0) AS b
FROM scoped_fit GROUP BY order_id""", ("scoped_fit",))


@query("scoped_promotion", sql("""
SELECT f.order_id, coalesce(fitting, 0) AS fitting, b.id AS promotion_id, b.t AS promotion_type, coalesce(b.d, 0.0::DOUBLE) AS discount_amount,
       f.total_value - coalesce(b.d, 0.0::DOUBLE) AS discounted_total, f.total_value - coalesce(b.d, 0.0::DOUBLE) <= 0 AS rejected
FROM scoped_facts f LEFT JOIN scoped_best USING (order_id)""", "scoped_facts", "scoped_best"), "L9 N")
def q_scoped_promotion(spark, d):
    """Fixed, percentage and buy-one-get-one rules by promotion number, aimed at segments, channels and payment methods at once."""
    rules = PR.promotion_calendar(typed(log_of(spark, d), "PromotionApplied", ["promotion_id"])).withColumn("n", F.col("value").cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("percentage", "fixed", "bogo", "percentage")]), F.col("n") % 4 + 1)
    rules = rules.select("promotion_id", "n", kind.alias("promotion_type"), F.when(F.col("n") % 4 == 1, F.col("value") * 20000).otherwise(F.col("value")).alias("value"), "start_day", "end_day")
    aims = [("segment", ["premium", "regular"], 2), ("channel", ["app", "rep"], 3), ("payment", ["credit"], 5)]
    conditions = None
    for scope, values, every in aims:
        own = rules.filter(F.col("n") % every == 0).select("promotion_id", F.lit(scope).alias("scope"), F.explode(F.array(*[F.lit(v) for v in values])).alias("scope_value"))
        conditions = own if conditions is None else conditions.unionByName(own)
    t = tables_of(spark, d)
    o = t["orders"].select("order_id", "customer_id", "created_at", "total_value", "channel").join(t["customers"].select("customer_id", "segment", "payment_method"), "customer_id", "left")
    return PR.best_fitting(o, {"segment": F.col("segment"), "channel": F.col("channel"), "payment": F.col("payment_method")}, rules.drop("n"), conditions)


cte("credit_ev", """
SELECT u.*, coalesce(c.credit_limit, 0.0::DOUBLE) AS credit_limit,
       row_number() OVER (PARTITION BY u.customer_id ORDER BY ts, k, order_id) AS rn
FROM (SELECT customer_id, created_at AS ts, 'order' AS kind, order_id, total_value AS amount, 1 AS k FROM ord
      UNION ALL SELECT customer_id, created_at + INTERVAL 4 DAY, 'release', order_id, total_value, 0 FROM ord
      WHERE orderstatus = 'F'
      UNION ALL SELECT customer_id, created_at + INTERVAL 1 HOUR, 'release', order_id, total_value, 0 FROM ord
      WHERE orderstatus = 'P' AND orderkey % 25 = 0) u
LEFT JOIN cust c ON u.customer_id = c.customer_id""", ("ord", "cust"))
cte("credit_walk", """
SELECT customer_id, rn, ts, kind, order_id, amount, CASE WHEN kind = 'order' THEN 0.0::DOUBLE + amount <= credit_limit END AS accepted,
       CASE WHEN kind = 'order' AND 0.0::DOUBLE + amount <= credit_limit THEN 0.0::DOUBLE + amount ELSE 0.0::DOUBLE END AS used_after,
       CASE WHEN kind = 'order' AND 0.0::DOUBLE + amount <= credit_limit THEN [order_id] ELSE CAST([] AS VARCHAR[]) END AS open_ids
FROM credit_ev WHERE rn = 1
UNION ALL
SELECT e.customer_id, e.rn, e.ts, e.kind, e.order_id, e.amount,
       CASE WHEN e.kind = 'order' THEN w.used_after + e.amount <= e.credit_limit END,
       CASE WHEN e.kind = 'order' AND w.used_after + e.amount <= e.credit_limit THEN w.used_after + e.amount
            WHEN e.kind = 'release' AND list_contains(w.open_ids, e.order_id) THEN greatest(0.0::DOUBLE, w.used_after - e.amount)
            ELSE w.used_after END,
       CASE WHEN e.kind = 'order' AND w.used_after + e.amount <= e.credit_limit THEN list_append(w.open_ids, e.order_id)
            WHEN e.kind = 'release' THEN list_filter(w.open_ids, lambda x: x <> e.order_id) ELSE w.open_ids END
FROM credit_walk w JOIN credit_ev e ON e.customer_id = w.customer_id AND e.rn = w.rn + 1""", ("credit_ev",))


@query("credit_check", sql("""
SELECT customer_id, ts, kind, order_id, CASE WHEN kind = 'order' THEN amount END AS amount, accepted, used_after
FROM credit_walk""", "credit_walk", recursive=True), "L11")
def q_credit_check(spark, d):
    log = log_of(spark, d)
    rel = read_events(log, "OrderDelivered", "OrderCancelled").select(
        F.get_json_object("payload", "$.order_id").alias("order_id"),
        F.get_json_object("payload", "$.customer_id").alias("customer_id"), "timestamp")
    return CR.credit_check(tables_of(spark, d)["orders"], rel, tables_of(spark, d)["customers"])


DUNNING_AS_OF = "1998-06-30 12:00:00"  # amid the orders: invoices of every stage are open then
cte("dun_asof", f"SELECT TIMESTAMP '{DUNNING_AS_OF}' AS as_of")


@query("dunning", sql(f"""
SELECT invoice_id, customer_id, amount, failed_attempts, stage,
       CAST(CASE WHEN NOT paid AND NOT wo THEN overdue ELSE 0 END AS INTEGER) AS days_overdue,
       CASE WHEN paid OR wo THEN 'closed' WHEN overdue >= 91 THEN '90+' WHEN overdue >= 61 THEN '61-90'
            WHEN overdue >= 31 THEN '31-60' WHEN overdue >= 1 THEN '1-30' ELSE 'current' END AS ageing_bucket,
       age >= 180 AND NOT paid AND NOT wo AS write_off_due
FROM (SELECT i.invoice_id, i.customer_id, i.amount, coalesce(p.fails, 0) AS failed_attempts,
             p.paid_at IS NOT NULL AND p.paid_at <= a.as_of AS paid,
             w.wo_at IS NOT NULL AND w.wo_at <= a.as_of AS wo,
             CASE WHEN p.paid_at IS NOT NULL AND p.paid_at <= a.as_of THEN 'paid'
                  WHEN w.wo_at IS NOT NULL AND w.wo_at <= a.as_of THEN 'written_off'
                  WHEN coalesce(p.fails, 0) >= 3 THEN 'collection'
                  WHEN CAST(a.as_of AS DATE) > CAST(i.due_date AS DATE) THEN 'overdue' ELSE 'open' END AS stage,
             greatest(0, datediff('day', CAST(i.due_date AS DATE), CAST(a.as_of AS DATE))) AS overdue,
             (epoch_us(a.as_of) - epoch_us(i.timestamp)) / {float(D_US)} AS age
      FROM invoices_t i
      LEFT JOIN (SELECT invoice_id, count(*) FILTER (WHERE status = 'failed') AS fails,
                        min(CASE WHEN status = 'paid' THEN timestamp END) AS paid_at
                 FROM payments_t, dun_asof WHERE timestamp <= as_of GROUP BY invoice_id) p ON i.invoice_id = p.invoice_id
      LEFT JOIN (SELECT invoice_id, min(timestamp) AS wo_at FROM writeoffs_t GROUP BY invoice_id) w
             ON i.invoice_id = w.invoice_id, dun_asof a WHERE i.timestamp <= a.as_of)""", "invoices_t", "payments_t", "writeoffs_t", "dun_asof"),
    "L15")
def q_dunning(spark, d):
    log = log_of(spark, d)
    inv, pay = tables_of(spark, d)["invoices"], tables_of(spark, d)["payments"]
    wo = typed(log, "CreditWrittenOff", ["invoice_id"])
    as_of = spark.range(1).agg(F.max(F.to_timestamp(F.lit(DUNNING_AS_OF))).alias("as_of"))  # one row
    return CR.dunning(inv, pay, wo, as_of).select(
        "invoice_id", "customer_id", "amount", "failed_attempts", "stage", "days_overdue", "ageing_bucket",
        "write_off_due")


# --- I1–I5 -----------------------------------------------------------------------------------------
@query("noise_counts", sql("""
SELECT CAST(floor(n * 0.001::DOUBLE) AS BIGINT) AS out_of_order,
       greatest(CAST(1 AS BIGINT), CAST(floor(n * 0.0001::DOUBLE) AS BIGINT)) AS corrupt,
       CAST(floor(n * 0.02::DOUBLE) AS BIGINT) AS late, n AS rows
FROM total_events""", "total_events"), "I1 I2 I3 I4 I5 A16")
def q_noise_counts(spark, d):
    from ..operators.noise import inject_noise

    return inject_noise(log_of(spark, d))[1]


@query("noisy_order_totals", None, "I4 B6 T18")
def q_noisy_orders(spark, d):
    """Orders rebuilt from the noisy log: corrupted totals read as null (lenient cast) or negative."""
    from ..operators.noise import inject_noise

    noisy, _ = inject_noise(log_of(spark, d))
    o = P.orders(noisy)
    return o.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("total_value").isNull()).alias("null_totals"),
                 F.count_if(F.col("total_value") < 0).alias("negative_totals"))


cte("noisy_pick", """
SELECT *, row_number() OVER (ORDER BY md5('127|' || id), id) <= CAST(floor(n * 0.05::DOUBLE) AS BIGINT) AS oor,
       row_number() OVER (ORDER BY md5('128|' || id), id) <= CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS cor,
       row_number() OVER (ORDER BY md5('129|' || id), id) <= CAST(floor(n * 0.02::DOUBLE) AS BIGINT) AS late,
       ('0x' || substr(md5('42|' || id || '|field'), 1, 8))::BIGINT % 2 AS field, ('0x' || substr(md5('42|' || id || '|mode'), 1, 8))::BIGINT % 2 = 0 AS gone
FROM (SELECT *, replace(invoice_id, 'INV-', 'IC-') AS id, count(*) OVER () AS n FROM invoices_t)""", ("invoices_t",))


@query("noisy_invoices", sql("""
SELECT invoice_id, CASE WHEN cor AND field = 0 THEN CASE WHEN gone THEN NULL ELSE -abs(amount) END ELSE amount END AS amount,
       CASE WHEN cor AND field = 1 THEN CASE WHEN gone THEN NULL ELSE -abs(terms_days) END ELSE terms_days END AS terms_days,
       timestamp - CASE WHEN oor THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END - CASE WHEN late THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS timestamp
FROM noisy_pick""", "noisy_pick"), "I1 I2 I3 I4 I5")
def q_noisy_invoices(spark, d):
    """The invoices of a log of invoices alone, with more noise than usual."""
    from ..operators.noise import NoiseConfig, inject_noise

    log = read_events(log_of(spark, d), "InvoiceCreated")
    noisy, _ = inject_noise(log, NoiseConfig(out_of_order_rate=0.05, corruption_rate=0.1, late_arrival_rate=0.02))
    return typed(noisy, "InvoiceCreated", ["invoice_id", "amount", "terms_days"]).select("invoice_id", "amount", "terms_days", "timestamp")


# The true trailing-90-day basket mean as the baseline (the seeded path uses RFM monetary)

cte("enriched90", """
SELECT e.* EXCLUDE (avg_basket_90d), m.mean_90d AS avg_basket_90d
FROM enriched e JOIN feat_m90 m ON e.order_id = m.order_id""", ("enriched", "feat_m90"))
cte("factors90", _CTES["factors"][0].replace("FROM enriched e", "FROM enriched90 e"), ("enriched90",))
cte("scored90", _CTES["scored"][0].replace("FROM factors f", "FROM factors90 f"), ("factors90",))
cte("decided90", _CTES["decided"][0].replace("FROM scored s", "FROM scored90 s"), ("scored90",))


@query("order_scores_true_baseline", sql("""
SELECT order_id, avg_basket_90d, payment_score, decision_score, decision FROM decided90""", "decided90"),
    "T8 L2 J1 J4")
def q_scores_true_baseline(spark, d):
    from ..operators import decision as J
    from .q_decision import SEEDED_ZERO_IS_MISSING

    t = tables_of(spark, d)
    base = L.order_features(t["orders"], t["customers"]).select("order_id", F.col("mean_90d").alias("avg_basket_90d"))
    e = J.enrich_orders(t["orders"], t["customers"], t["rfm_scores"], basket_baseline=base)
    return J.score(e, zero_is_missing=SEEDED_ZERO_IS_MISSING).select(
        "order_id", "avg_basket_90d", "payment_score", "decision_score", "decision")
