"""Consistency checks, KPI range gates, row validators, domain and business rules.

Every check is an aggregate (one row) or a grouped count; the scorecard is their union, so
the whole gate is one Spark job per table with no driver-side loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_DAY
from .projections import money

# Gate bounds as enforced in code (T15; labels in the spec are narrower)
DEFAULT_BOUNDS = {
    "K1-avg-order-value": (5_000.0, 460_000.0),
    "K2-churn-rate": (0.05, 0.50),
    "K3-dso-days": (10.0, 120.0),
    "K4-stockout-rate": (0.01, 0.35),
    "K5-open-orders": (0.05, None),
    "K6-overdue-invoices": (0.10, None),
}
LINE_TOLERANCE = 0.02
BALANCE_TOLERANCE = -0.01


@dataclass
class Bounds:
    gates: dict = field(default_factory=lambda: dict(DEFAULT_BOUNDS))


def _check(name: str, value: Column, ok: Column) -> list[Column]:
    return [F.lit(name).alias("check"), ok.alias("ok"), value.cast("double").alias("value")]


def _between(v: Column, lo: float | None, hi: float | None) -> Column:
    c = F.lit(True)
    if lo is not None:
        c = c & (v >= F.lit(lo))
    if hi is not None:
        c = c & (v <= F.lit(hi))
    return c


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def c1_orphans(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """H1: distinct order customers missing from customers (anti join)."""
    n = orders.select("customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti").agg(
        F.count(F.lit(1)).alias("n"))
    return n.select(*_check("C1-no-orphan-orders", F.col("n"), F.col("n") == 0))


def line_sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.sum(money("line_total")).cast("double").alias("lines_total"))


def c2_line_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """H2: |total − Σ lines| > 0.02 over orders that have lines (inner join)."""
    j = orders.select("order_id", "total_value").join(line_sums(lines), "order_id")
    n = j.agg(F.count_if(F.abs(F.col("total_value") - F.col("lines_total")) > LINE_TOLERANCE).alias("n"))
    return n.select(*_check("C2-line-totals-match", F.col("n"), F.col("n") == 0))


def final_balances(ledger: DataFrame) -> DataFrame:
    """Last running balance per customer by (timestamp, event_id)."""
    return ledger.groupBy("customer_id").agg(
        F.max_by("running_balance", F.struct("timestamp", "event_id")).alias("balance"))


def c3_final_balance(ledger: DataFrame) -> DataFrame:
    """H3: customers whose final balance is below −0.01."""
    n = final_balances(ledger).agg(F.count_if(F.col("balance") < BALANCE_TOLERANCE).alias("n"))
    return n.select(*_check("C3-credit-used-nonneg", F.col("n"), F.col("n") == 0))


def k1_aov(orders: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    v = orders.agg((F.sum(money("total_value")).cast("double") / F.count("total_value")).alias("v"))
    return v.select(*_check("K1-avg-order-value", F.col("v"), _between(F.col("v"), *b["K1-avg-order-value"])))


def k2_churn(customers: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    v = customers.agg(_ratio(F.count_if(F.col("status") == "churned"), F.count(F.lit(1))).alias("v"))
    return v.select(*_check("K2-churn-rate", F.col("v"), _between(F.col("v"), *b["K2-churn-rate"])))


def dso_days(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    paid = payments.filter(F.col("status") == "paid").select("invoice_id", F.col("timestamp").alias("paid_at"))
    j = invoices.select("invoice_id", "timestamp").join(paid, "invoice_id")
    days = F.call_function("div", F.unix_micros("paid_at") - F.unix_micros("timestamp"), F.lit(MICROS_PER_DAY))
    return j.select(days.alias("days"))


def k3_dso(invoices: DataFrame, payments: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    """H6: mean whole days invoice → paid (truncated; 30 when there is nothing to measure)."""
    v = dso_days(invoices, payments).agg(
        F.coalesce(F.sum("days").cast("double") / F.count("days"), F.lit(30.0)).alias("v"))
    return v.select(*_check("K3-dso-days", F.col("v"), _between(F.col("v"), *b["K3-dso-days"])))


def k4_stockout(snapshot: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    v = snapshot.agg(_ratio(F.count_if(F.col("estimated_on_hand") <= 0), F.count(F.lit(1))).alias("v"))
    return v.select(*_check("K4-stockout-rate", F.col("v"), _between(F.col("v"), *b["K4-stockout-rate"])))


def k5_open(orders: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    v = orders.agg(_ratio(F.count_if(~F.col("status").isin("OrderDelivered")), F.count(F.lit(1))).alias("v"))
    return v.select(*_check("K5-open-orders", F.col("v"), _between(F.col("v"), *b["K5-open-orders"])))


def k6_overdue(invoices: DataFrame, payments: DataFrame, b=DEFAULT_BOUNDS) -> DataFrame:
    """H9: invoices without a paid payment (anti join) over all invoices."""
    paid = payments.filter(F.col("status") == "paid").select("invoice_id")
    flagged = invoices.select("invoice_id").join(
        paid.distinct().withColumn("_paid", F.lit(True)), "invoice_id", "left")
    v = flagged.agg(_ratio(F.count_if(F.col("_paid").isNull()), F.count(F.lit(1))).alias("v"))
    return v.select(*_check("K6-overdue-invoices", F.col("v"), _between(F.col("v"), *b["K6-overdue-invoices"])))


def scorecard(tables: dict[str, DataFrame], bounds: dict | None = None) -> DataFrame:
    """One row per check (check, ok, value); a check whose tables are absent is skipped."""
    b = bounds or DEFAULT_BOUNDS
    t = tables
    plan = [
        (("orders", "customers"), lambda: c1_orphans(t["orders"], t["customers"])),
        (("orders", "order_lines"), lambda: c2_line_totals(t["orders"], t["order_lines"])),
        (("credit_ledger",), lambda: c3_final_balance(t["credit_ledger"])),
        (("orders",), lambda: k1_aov(t["orders"], b)),
        (("customers",), lambda: k2_churn(t["customers"], b)),
        (("invoices", "payments"), lambda: k3_dso(t["invoices"], t["payments"], b)),
        (("inventory_snapshot",), lambda: k4_stockout(t["inventory_snapshot"], b)),
        (("orders",), lambda: k5_open(t["orders"], b)),
        (("invoices", "payments"), lambda: k6_overdue(t["invoices"], t["payments"], b)),
    ]
    parts = [fn() for needs, fn in plan if all(n in t and t[n] is not None for n in needs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- H11/H12: row validators and domain rules -------------------------------------------------
def order_row_violations(order_events: DataFrame) -> DataFrame:
    """H11 on typed OrderCreated rows: line_total = qty·price − discount (±0.02) for every line,
    and total = Σ line totals (±0.02), evaluated with array functions inside the row."""
    bad_line = F.exists(
        "lines",
        lambda l: F.abs(l["line_total"] - (l["quantity"] * l["unit_price"] - l["discount_amount"])) > LINE_TOLERANCE,
    )
    lines_sum = F.aggregate("lines", F.lit(0.0), lambda acc, l: acc + l["line_total"])
    return order_events.select(
        "order_id",
        F.coalesce(bad_line, F.lit(False)).alias("bad_line_total"),
        (F.abs(F.col("total_value") - lines_sum) > LINE_TOLERANCE).alias("bad_order_total"),
    )


# Fixed values (typed events): rule id → (event type, predicate that must hold), value and enum rules
DOMAIN_RULES: dict[str, tuple[str, str]] = {
    "order_total_positive": ("OrderCreated", "total_value > 0"),
    "order_has_lines": ("OrderCreated", "size(lines) >= 1"),
    "order_channel_enum": ("OrderCreated", "channel IN ('rep', 'app', 'direct', 'organic')"),
    "order_fraud_unit": ("OrderCreated", "fraud_score BETWEEN 0 AND 1"),
    "line_quantity_positive": ("OrderCreated", "forall(lines, l -> l.quantity > 0)"),
    "line_price_positive": ("OrderCreated", "forall(lines, l -> l.unit_price > 0 AND l.line_total > 0)"),
    "line_class_enum": ("OrderCreated", "forall(lines, l -> l.demand_class IN ('A', 'B', 'C'))"),
    "receipt_quantity_positive": ("StockReceived", "quantity > 0"),
    "reserve_quantity_positive": ("StockReserved", "quantity > 0"),
    "stockout_requested_positive": ("StockoutOccurred", "requested_quantity > 0"),
    "stockout_available_nonneg": ("StockoutOccurred", "available_quantity >= 0"),
    "stockout_resolution_enum": ("StockoutOccurred", "resolution IN ('substitute', 'backorder', 'cancel_line')"),
    "invoice_amount_positive": ("InvoiceCreated", "amount > 0"),
    "invoice_terms_nonneg": ("InvoiceCreated", "terms_days >= 0"),
    "payment_amount_positive": ("PaymentCaptured", "amount > 0"),
    "failed_attempt_positive": ("PaymentFailed", "attempt_number >= 1"),
    "visit_outcome_enum": ("RepVisitCompleted",
                           "outcome IN ('no_order', 'small_order', 'large_order', 'reactivation')"),
    "app_subtype_enum": ("AppSessionEvent", "event_subtype IN ('session_start', 'screen_view', 'product_search', "
                                            "'order_placed', 'session_end')"),
    "customer_risk_unit": ("CustomerCreated", "risk_score BETWEEN 0 AND 1"),
    "customer_limit_nonneg": ("CustomerCreated", "credit_limit >= 0"),
}


def domain_violations(log: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(rule_id, event_type, checked, violations) — one aggregate pass per event type.

    A null field fails its rule (``coalesce(pred, false)``), as a missing required value would."""
    from ..sources.eventlog import typed

    rules = rules or DOMAIN_RULES
    by_type: dict[str, list[tuple[str, str]]] = {}
    for rid, (et, pred) in rules.items():
        by_type.setdefault(et, []).append((rid, pred))
    parts = []
    for et, rs in by_type.items():
        ev = typed(log, et)
        aggs = [F.count(F.lit(1)).alias("_n")] + [
            F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(rid) for rid, p in rs
        ]
        wide = ev.agg(*aggs)
        stack = ", ".join(f"'{rid}', `{rid}`" for rid, _ in rs)
        parts.append(wide.selectExpr(
            f"'{et}' AS event_type", "_n AS checked", f"stack({len(rs)}, {stack}) AS (rule_id, violations)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule_id", "event_type", "checked", "violations")


def quarantine(log: DataFrame, event_type: str, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows of one event type that fail any rule, with the failed rule ids."""
    from ..sources.eventlog import typed

    rs = [(rid, p) for rid, (et, p) in (rules or DOMAIN_RULES).items() if et == event_type]
    ev = typed(log, event_type)
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(rid)) for rid, p in rs]),
        lambda x: x.isNotNull(),
    )
    return ev.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)


# --- H13: business rules as columns ----------------------------------------------------------
def cr01_credit(used: Column, order_total: Column, limit: Column) -> Column:
    """CR-01: credit_used + order_total ≤ credit_limit."""
    return (used + order_total) <= limit


def cr02_status(status: Column) -> Column:
    """CR-02: customer must not be churned."""
    return status != "churned"


def coll01_promise(promise_date: Column, today: Column) -> Column:
    """COLL-01: the promise date is not in the past."""
    return promise_date >= today


def inv01_stock(available: Column, requested: Column) -> Column:
    """INV-01: enough stock."""
    return available >= requested


def pay01_capture(balance: Column, payment: Column) -> Column:
    """PAY-01: never capture more than the outstanding balance."""
    return F.least(balance, payment)


def business_rule_violations(ledger: DataFrame, customers: DataFrame, history: DataFrame, orders: DataFrame,
                             stockouts: DataFrame, payments: DataFrame, invoices: DataFrame,
                             promises: DataFrame) -> DataFrame:
    """H13 over the projected tables: (rule_id, checked, violations).

    CR-01 uses the balance before each debit (running balance − the debit);
    CR-02 flags orders placed after the customer's churn event; COLL-01 flags promises
    (``promise_date``, ``timestamp``) to pay on a day before they were made;
    INV-01 checks stockouts; PAY-01 flags captures above the invoice's open balance."""
    debits = ledger.filter(F.col("transaction_type") == "debit").join(
        customers.select("customer_id", "credit_limit"), "customer_id", "left")
    cr01 = debits.agg(
        F.lit("CR-01").alias("rule_id"), F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.coalesce(cr01_credit(F.col("running_balance") - F.col("signed_amount"), F.col("amount"),
                                           F.col("credit_limit")), F.lit(False))).alias("violations"))
    churn = history.filter(F.col("event_type") == "CustomerChurned").groupBy("customer_id").agg(
        F.min("timestamp").alias("churned_at"))
    o = orders.select("customer_id", "created_at").join(churn, "customer_id", "left")
    status_at_order = F.when(F.col("churned_at") < F.col("created_at"), "churned").otherwise("active")
    cr02 = o.agg(F.lit("CR-02").alias("rule_id"), F.count(F.lit(1)).alias("checked"),
                 F.count_if(~cr02_status(status_at_order)).alias("violations"))
    inv01 = stockouts.agg(
        F.lit("INV-01").alias("rule_id"), F.count(F.lit(1)).alias("checked"),
        F.count_if(~inv01_stock(F.col("available_quantity"), F.col("requested_quantity"))).alias("violations"))
    paid = payments.filter(F.col("status") == "paid").groupBy("invoice_id").agg(
        F.sum(money("amount")).cast("double").alias("captured"))
    pj = invoices.select("invoice_id", "amount").join(paid, "invoice_id")
    pay01 = pj.agg(F.lit("PAY-01").alias("rule_id"), F.count(F.lit(1)).alias("checked"),
                   F.count_if(pay01_capture(F.col("amount"), F.col("captured")) < F.col("captured")).alias("violations"))
    kept = coll01_promise(F.to_date("promise_date"), F.to_date("timestamp"))
    coll01 = promises.agg(F.lit("COLL-01").alias("rule_id"), F.count(F.lit(1)).alias("checked"),
                          F.count_if(~F.coalesce(kept, F.lit(False))).alias("violations"))
    return cr01.unionByName(cr02).unionByName(inv01).unionByName(pay01).unionByName(coll01)


# --- H14–H21: audit queries -----------------------------------------------------------------------
def smoke_assertions(log: DataFrame, orders: DataFrame, customers: DataFrame, min_events: int = 1000,
                     max_orphan_rate: float = 0.03) -> DataFrame:
    """Enough events and an orphan-order rate under 3 %."""
    ev = log.agg(F.count(F.lit(1)).alias("v")).select(
        *_check("events-at-least", F.col("v"), F.col("v") >= min_events))
    j = orders.select("customer_id").join(customers.select("customer_id").withColumn("_k", F.lit(1)),
                                          "customer_id", "left")
    orph = j.agg(_ratio(F.count_if(F.col("_k").isNull()), F.count(F.lit(1))).alias("v")).select(
        *_check("orphan-rate-below", F.col("v"), F.col("v") < max_orphan_rate))
    return ev.unionByName(orph)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def impossible_values(orders: DataFrame, payments: DataFrame, invoices: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Negative or zero values that the schema forbids, counted per field."""
    a = orders.agg(F.count_if(F.col("fraud_score") < 0).alias("n")).select(F.lit("fraud_score<0").alias("field"), "n")
    b = payments.agg(F.count_if(F.col("attempt_number") <= 0).alias("n")).select(F.lit("attempt_number<=0"), "n")
    c = invoices.agg(F.count_if(F.col("terms_days") < 0).alias("n")).select(F.lit("terms_days<0"), "n")
    d = snapshot.agg(F.count_if(F.col("estimated_on_hand") < 0).alias("n")).select(F.lit("stock<0"), "n")
    e = payments.agg(F.count_if(F.col("amount") < 0).alias("n")).select(F.lit("amount<0"), "n")
    out = a
    for p in (b, c, d, e):
        out = out.union(p)
    return out.toDF("field", "violations")


def paid_before_invoiced(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Captured payments time-stamped before their invoice."""
    p = payments.filter(F.col("status") == "paid").select("invoice_id", F.col("timestamp").alias("paid_at"))
    j = invoices.select("invoice_id", "timestamp").join(p, "invoice_id")
    return j.agg(F.count_if(F.col("paid_at") < F.col("timestamp")).alias("violations"))


def null_coverage(df: DataFrame, by: str, col: str) -> DataFrame:
    """Share of non-null ``col`` per ``by`` value."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count(col).alias("non_null"),
        (F.count(col).cast("double") / F.count(F.lit(1))).alias("coverage"))


def unstable_dimension(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Keys seen with more than one attribute value."""
    return df.groupBy(key).agg(F.countDistinct(attr).alias("values")).filter(F.col("values") > 1)


def promotion_reconciliation(applied: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with a redemption vs orders carrying a promotion id (two aggregates joined)."""
    a = applied.agg(F.countDistinct("order_id").alias("orders_redeemed"), F.count(F.lit(1)).alias("redemptions"))
    b = orders.agg(F.count_if(F.col("promotion_id").isNotNull()).alias("orders_with_promotion"))
    return a.crossJoin(b)  # one row each


def missing_days(df: DataFrame, ts: str) -> DataFrame:
    """Calendar days between the first and last timestamp with no rows (sequence + anti join).

    The generated calendar has one row per day in the span (bounded by the calendar)."""
    days = df.select(F.to_date(ts).alias("day")).distinct()
    span = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return cal.join(days, "day", "left_anti").select(F.date_format("day", "yyyy-MM-dd").alias("day"))
