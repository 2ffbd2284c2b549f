"""Dashboard metrics and the analyst cookbook over the projected tables.

Money is summed in exact cents (``money``) and averages are ``sum / count``; every top-k has
a total order (ties broken by key) so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_rank
from .projections import money


def _dsum(c: str):
    return F.sum(money(c)).cast("double")


def _pct(num, den):
    return num.cast("double") * F.lit(100.0) / den.cast("double")


# --- K1–K5: dashboard tiles ------------------------------------------------------------------
def kpi_tile(orders: DataFrame) -> DataFrame:
    """K1: orders, GMV, AOV, distinct customers, orders with fraud > 0.5."""
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        _dsum("total_value").alias("gmv"),
        (_dsum("total_value") / F.count(F.lit(1))).alias("aov"),
        F.countDistinct("customer_id").alias("customers"),
        F.count_if(F.col("fraud_score") > 0.5).alias("high_fraud_orders"),
    )


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """K2/K3: row counts by one or more columns, largest first."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *cols)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between min and max, nulls dropped (one pass + a 1-row bound)."""
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    ).cast("int")
    return (
        v.crossJoin(F.broadcast(bounds))  # one row
        .withColumn("bin", b)
        .groupBy("bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "count")
    )


def monthly_gmv_text(orders: DataFrame) -> DataFrame:
    """K5: GMV per ``%Y-%m`` month."""
    return orders.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        _dsum("total_value").alias("gmv"), F.count(F.lit(1)).alias("orders")
    )


# --- K8: key joins -----------------------------------------------------------------------------
def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    c = customers.select("customer_id", "segment", "area_id", "customer_type", F.col("status").alias("customer_status"))
    return orders.filter(F.col("total_value") > 0).join(c, "customer_id").select(
        "order_id", "created_at", "total_value", "status", "channel", "segment", "area_id", "customer_type",
        "customer_status",
    )


def order_invoice_payment(orders: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """K8 chain with D9: the ``status = 'paid'`` predicate sits in the left join's ON clause."""
    i = invoices.select("invoice_id", "order_id", "due_date")
    p = payments.select(
        F.col("invoice_id").alias("p_invoice_id"), F.col("status").alias("payment_status"),
        F.col("timestamp").alias("paid_at"), "payment_method",
    )
    j = orders.select("order_id", "created_at", "total_value").join(i, "order_id")
    j = j.join(p, (j.invoice_id == p.p_invoice_id) & (p.payment_status == "paid"), "left")
    return j.select("order_id", "created_at", "total_value", "invoice_id", "due_date", "payment_status", "paid_at",
                    "payment_method")


def lines_with_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    return lines.join(orders.select("order_id", "created_at", "channel"), "order_id").select(
        "order_id", "sku_id", "quantity", "line_total", "demand_class", "created_at", "channel"
    )


def rfm_with_customers(rfm: DataFrame, customers: DataFrame) -> DataFrame:
    return rfm.join(customers.select("customer_id", "segment", "status", "area_id"), "customer_id").select(
        "customer_id", "month", "r_score", "f_score", "m_score", "recency_days", "monetary", "segment", "status",
        "area_id",
    )


# --- K10–K17: recipes ----------------------------------------------------------------------------
def clv_by_segment(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """K10 (E8): distinct customers mixed with sums."""
    o = orders.filter((F.col("status") == "OrderDelivered") & (F.col("total_value") > 0))
    j = o.join(customers.select("customer_id", "segment"), "customer_id")
    n = F.countDistinct("customer_id")
    return j.groupBy("segment").agg(
        n.alias("customers"),
        (_dsum("total_value") / n).alias("avg_clv"),
        (_dsum("total_value") / F.count(F.lit(1))).alias("avg_order_value"),
        (F.count("order_id").cast("double") / n).alias("orders_per_customer"),
    )


def churn_by_cohort(orders: DataFrame, history: DataFrame) -> DataFrame:
    """K11 (F8): first delivered-order month cohort ⟕ churn events."""
    first = orders.filter(F.col("status") == "OrderDelivered").groupBy("customer_id").agg(
        F.date_trunc("month", F.min("created_at")).alias("cohort_month")
    )
    churn = history.filter(F.col("event_type") == "CustomerChurned").select(
        F.col("customer_id").alias("churned_id"), F.date_trunc("month", "timestamp").alias("churn_month")
    )
    j = first.join(churn, first.customer_id == churn.churned_id, "left")
    return j.groupBy("cohort_month").agg(
        F.count("customer_id").alias("cohort_size"),
        F.count("churned_id").alias("churned"),
        _pct(F.count("churned_id"), F.count("customer_id")).alias("churn_pct"),
    )


def dso_stats(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """K12 (E6): calendar-day DSO mean, median and P90 of paid invoices.

    ``percentile`` is exact; its buffer holds one entry per distinct day count (bounded)."""
    p = payments.filter(F.col("status") == "paid").select("invoice_id", F.col("timestamp").alias("paid_at"))
    j = invoices.select("invoice_id", "timestamp").join(p, "invoice_id")
    d = F.datediff(F.to_date("paid_at"), F.to_date("timestamp"))
    return j.select(d.alias("d")).agg(
        (F.sum("d").cast("double") / F.count("d")).alias("avg_dso_days"),
        F.round(F.percentile("d", 0.5), 6).alias("median_dso"),
        F.round(F.percentile("d", 0.9), 6).alias("p90_dso"),
    )


def rep_leaderboard(rep_perf: DataFrame, months: int = 6, k: int = 10) -> DataFrame:
    """K13 (F6): the last ``months`` months relative to the latest month, top-k by GMV."""
    latest = rep_perf.agg(F.max("month").alias("latest"))
    r = rep_perf.crossJoin(F.broadcast(latest)).filter(
        F.col("month") >= F.add_months(F.col("latest"), -(months - 1))
    )
    g = r.groupBy("rep_id").agg(
        F.sum("total_visits").alias("visits"),
        F.sum("order_visits").alias("orders_from_visits"),
        _pct(F.sum("order_visits"), F.sum("total_visits")).alias("conversion_pct"),
        (F.sum(money("gmv")).cast("double") / F.lit(1e6)).alias("gmv_million"),
    )
    return g.orderBy(F.desc_nulls_last("gmv_million"), F.asc("rep_id")).limit(k)


def sku_stockout_frequency(stockouts: DataFrame, k: int = 20) -> DataFrame:
    """K14 (E10): SUM(CASE WHEN) pivot by resolution, top-k by events."""
    def n(r):
        return F.count_if(F.col("resolution") == r)

    g = stockouts.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("stockout_events"),
        n("cancel_line").alias("cancellations"),
        n("substitute").alias("substitutes"),
        n("backorder").alias("backorders"),
    )
    return g.orderBy(F.desc("stockout_events"), F.asc("sku_id")).limit(k)


def payment_mix_by_area(payments: DataFrame, customers: DataFrame) -> DataFrame:
    """K15."""
    p = payments.filter(F.col("status") == "paid")
    j = p.join(customers.select("customer_id", "area_id"), "customer_id")
    return j.groupBy("area_id", "payment_method").agg(
        F.count(F.lit(1)).alias("payments"), (_dsum("amount") / F.lit(1e6)).alias("total_million")
    )


def rfm_champions(rfm: DataFrame, customers: DataFrame) -> DataFrame:
    """K16 (F7): latest month via a one-row scalar aggregate, all three scores ≥ 4."""
    latest = rfm.agg(F.max("month").alias("latest"))
    r = rfm.join(F.broadcast(latest), rfm.month == latest.latest).filter(
        (F.col("r_score").cast("int") >= 4) & (F.col("f_score").cast("int") >= 4) & (F.col("m_score").cast("int") >= 4)
    )
    c = customers.select("customer_id", "name", "segment", "area_id", "customer_type")
    return r.join(c, "customer_id").select(
        "customer_id", "name", "segment", "area_id", "customer_type",
        F.col("r_score").cast("int").alias("r"), F.col("f_score").cast("int").alias("f"),
        F.col("m_score").cast("int").alias("m"), F.col("monetary").alias("trailing_gmv"), "recency_days",
    )


def credit_utilisation(ledger: DataFrame, customers: DataFrame, k: int = 20) -> DataFrame:
    """K17 (E7): min/max and the time-ordered last running balance, utilisation %, top-k."""
    g = ledger.groupBy("customer_id").agg(
        F.min("running_balance").alias("lowest_balance"),
        F.max("running_balance").alias("peak_balance"),
        F.max_by("running_balance", F.struct("timestamp", "event_id")).alias("current_balance"),
    )
    j = g.join(customers.select("customer_id", "segment", "credit_limit"), "customer_id")
    util = (F.col("credit_limit") - F.col("current_balance")) / F.when(F.col("credit_limit") != 0, F.col("credit_limit")) * 100
    return j.select(
        "customer_id", "segment", "credit_limit", "lowest_balance", "peak_balance", "current_balance",
        util.alias("utilization_pct"),
    ).orderBy(F.desc_nulls_last("utilization_pct"), F.asc("customer_id")).limit(k)


# --- K19–K24: validation-notes analyses ---------------------------------------------------------
def month_over_month(orders: DataFrame) -> DataFrame:
    """Monthly orders and GMV with the change against the previous month (``lag``).

    The window runs over one row per month (bounded by the calendar), not over orders."""
    m = orders.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), _dsum("total_value").alias("gmv")
    )
    w = Window.orderBy("month")
    prev = F.lag("gmv").over(w)
    return m.select(
        "month", "orders", "gmv", prev.alias("prev_gmv"),
        (F.col("gmv") - prev).alias("gmv_change"),
        (F.col("orders") - F.lag("orders").over(w)).alias("orders_change"),
    )


def time_profile(orders: DataFrame) -> DataFrame:
    """Orders by hour of day and ISO day of week."""
    return orders.groupBy(
        F.hour("created_at").alias("hour"), F.dayofweek("created_at").alias("dow")
    ).agg(F.count(F.lit(1)).alias("orders"), _dsum("total_value").alias("gmv"))


def revenue_concentration(lines: DataFrame) -> DataFrame:
    """Share of revenue held by the top 10 % and top 50 % of SKUs.

    SKU revenue is aggregated first (one row per SKU); the global rank comes from
    ``windows.global_rank`` (range-partitioned, no single-task window)."""
    s = lines.groupBy("sku_id").agg(F.sum(money("line_total")).alias("rev"))
    ranked = global_rank(s, "rev", "sku_id")
    totals = s.agg(F.count(F.lit(1)).alias("n"), F.sum("rev").alias("total"))  # one row
    t = ranked.crossJoin(F.broadcast(totals))

    def top(p):
        return F.sum(F.when(F.col("rank") <= F.ceil(F.col("n") * F.lit(p)), F.col("rev")))

    return t.groupBy("n", "total").agg(
        (top(0.1).cast("double") / F.col("total").cast("double")).alias("top10_share"),
        (top(0.5).cast("double") / F.col("total").cast("double")).alias("top50_share"),
    ).select(F.col("n").alias("skus"), "top10_share", "top50_share")


def return_rate_by_class(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Share of lines whose order was returned, by demand class."""
    j = lines.join(orders.select("order_id", "status"), "order_id")
    return j.groupBy("demand_class").agg(
        F.count(F.lit(1)).alias("lines"),
        _pct(F.count_if(F.col("status") == "OrderReturned"), F.count(F.lit(1))).alias("return_rate_pct"),
    )


def aov_by_area(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """K22b."""
    j = orders.join(customers.select("customer_id", "area_id"), "customer_id")
    return j.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("orders"), (_dsum("total_value") / F.count(F.lit(1))).alias("aov")
    )


def fraud_by_channel_status(orders: DataFrame) -> DataFrame:
    """Mean fraud score by channel × status (fraud scores are whole hundredths)."""
    return orders.groupBy("channel", "status").agg(
        F.count(F.lit(1)).alias("orders"),
        (F.sum(money("fraud_score")).cast("double") / F.count("fraud_score")).alias("mean_fraud"),
    )


def segment_channel_economics(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """AOV per segment × channel, its ratio to the segment AOV, and channel share of the segment.

    The share window runs over the (segment, channel) aggregate — a handful of rows."""
    j = orders.join(customers.select("customer_id", "segment"), "customer_id")
    g = j.groupBy("segment", "channel").agg(F.count(F.lit(1)).alias("orders"), F.sum(money("total_value")).alias("gmv"))
    w = Window.partitionBy("segment")
    seg_orders, seg_gmv = F.sum("orders").over(w), F.sum("gmv").over(w)
    aov = F.col("gmv").cast("double") / F.col("orders")
    return g.select(
        "segment", "channel", "orders", aov.alias("aov"),
        (aov / (seg_gmv.cast("double") / seg_orders)).alias("aov_ratio"),
        (F.col("orders").cast("double") / seg_orders).alias("channel_share"),
    )


def ledger_ratios(ledger: DataFrame) -> DataFrame:
    """Debit:credit ratio and write-off share of GMV (conditional sums in one pass)."""
    def s(t):
        return F.sum(F.when(F.col("transaction_type") == t, money("amount")))

    return ledger.agg(
        s("debit").cast("double").alias("debits"),
        s("credit").cast("double").alias("credits"),
        s("writeoff").cast("double").alias("writeoffs"),
    ).select(
        "debits", "credits", "writeoffs",
        (F.col("debits") / F.col("credits")).alias("debit_credit_ratio"),
        (F.col("writeoffs") / F.col("debits")).alias("writeoff_share"),
    )

