"""Registered queries: acquisition funnel and time to the first order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funnel as FN
from ..sources.eventlog import typed
from .oracle import cte, sql
from .q_projections import log_of, tables_of
from .registry import query

STAGES = ["first_order", "first_delivery", "first_payment"]

cte("fun_1", """
SELECT c.customer_id, c.segment AS cohort, c.created_at AS entered, min(o.created_at) AS first_order
FROM cust c LEFT JOIN orders_t o ON o.customer_id = c.customer_id AND o.created_at >= c.created_at GROUP BY ALL""", ("cust", "orders_t"))
cte("fun_2", """
SELECT f.*, d.t AS first_delivery FROM fun_1 f LEFT JOIN (
  SELECT f.customer_id, min(d.invoiced_at) AS t FROM fun_1 f JOIN delivered d ON d.customer_id = f.customer_id AND d.invoiced_at >= f.first_order GROUP BY ALL) d USING (customer_id)""", ("fun_1", "delivered"))
cte("fun_3", """
SELECT f.*, p.t AS first_payment FROM fun_2 f LEFT JOIN (
  SELECT f.customer_id, min(p.timestamp) AS t FROM fun_2 f JOIN payments_t p ON p.customer_id = f.customer_id AND p.status = 'paid' AND p.timestamp >= f.first_delivery GROUP BY ALL) p USING (customer_id)""", ("fun_2", "payments_t"))
cte("fun_long", """
SELECT cohort, 'entered' AS stage, 0 AS step, entered AS t, entered AS b FROM fun_3
UNION ALL SELECT cohort, 'first_order', 1, first_order, entered FROM fun_3
UNION ALL SELECT cohort, 'first_delivery', 2, first_delivery, first_order FROM fun_3
UNION ALL SELECT cohort, 'first_payment', 3, first_payment, first_delivery FROM fun_3""", ("fun_3",))


def times(spark, d):
    t, log = tables_of(spark, d), log_of(spark, d)
    entered = t["customers"].select("customer_id", F.col("created_at").alias("timestamp"), F.col("segment").alias("cohort"))
    return FN.stage_times(entered, {
        "first_order": t["orders"].select("customer_id", F.col("created_at").alias("timestamp")),
        "first_delivery": typed(log, "OrderDelivered", ["customer_id"]).select("customer_id", "timestamp"),
        "first_payment": t["payments"].filter("status = 'paid'").select("customer_id", "timestamp"),
    })


@query("acquisition_funnel", sql("""
SELECT cohort, stage, step, count(t) AS customers, CASE WHEN count(b) > 0 THEN count(t) / count(b) END AS conversion,
       CAST(quantile_disc((epoch_us(t) - epoch_us(b)) // 86400000000, 0.5) AS BIGINT) AS median_days
FROM fun_long GROUP BY ALL""", "fun_long"), "N")
def q_funnel(spark, d):
    return FN.conversion(times(spark, d), STAGES)


@query("first_order_survival", sql("""
SELECT cohort, day, at_risk, events, round(s, 9) AS survival
FROM (SELECT *, exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE '-infinity'::DOUBLE END) OVER (PARTITION BY cohort ORDER BY day)) AS s
      FROM (SELECT cohort, day, CAST(sum(hit) AS BIGINT) AS events, CAST(sum(count(*)) OVER (PARTITION BY cohort ORDER BY day DESC) AS BIGINT) AS at_risk
            FROM (SELECT cohort, coalesce(first_order <= now, false)::INT AS hit,
                         (epoch_us(CASE WHEN first_order <= now THEN first_order ELSE now END) - epoch_us(entered)) // 86400000000 AS day
                  FROM fun_1, (SELECT TIMESTAMP '1995-12-01' AS now) WHERE entered <= now)
            GROUP BY cohort, day))
WHERE events > 0""", "fun_1"), "N")
def q_survival(spark, d):
    """Days from a customer's creation to the first order, seen after a year."""
    now = spark.range(1).agg(F.max(F.to_timestamp(F.lit("1995-12-01 00:00:00"))).alias("now"))  # one row
    s = FN.survival(times(spark, d).select("customer_id", "cohort", "entered", "first_order"), "first_order", now)
    return s.withColumn("survival", F.round("survival", 9))
