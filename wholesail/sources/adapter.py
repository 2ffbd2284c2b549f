"""Derive the wholesale event log from the driver's TPC-H-like tables.

Every rule is deterministic and row-local (or a per-order aggregate of its lines), so the
log is a lazy union of branches.  For a branch with a fixed type, ``read_events(log, "X")``
is free: Catalyst pushes the ``event_type`` filter into the union child, folds the literal
comparison and drops the branch.  Branches whose type is chosen per row (order statuses,
payments, lifecycle) are filtered after they are generated — the reason queries read the
stored log (``logstore``), where every type is its own parquet partition.

The same rules are restated in SQL in ``wholesail.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import pick, rec, plus_days, plus_micros
from .eventlog import ENVELOPES, HEAD_FIELDS, LIFECYCLE_TYPES, ORDER_LINE, ORDER_STATUS_TYPES, REGISTRY, envelope, order_envelope
from .tables import Tables

# ---------------------------------------------------------------------------
# Fixed values of the mapping (must match plans/oracle.py)
# ---------------------------------------------------------------------------
PREMIUM_MKT = ["BUILDING"]                      # -> premium
REGULAR_MKT = ["AUTOMOBILE", "MACHINERY"]       # -> regular, anything else -> low_volume
PAYMENT_METHODS = ["credit", "bank_transfer", "direct_debit", "cheque", "cod", "cash"]  # custkey % 6
ACQUISITION_CHANNELS = ["rep", "digital", "referral"]                                   # custkey % 3
CUSTOMER_TYPES = ["grocery", "pharmacy", "kiosk", "supermarket"]                        # custkey % 4
CHANNEL_BY_PRIORITY = {"1": "rep", "2": "app", "3": "direct"}                            # else organic
VISIT_OUTCOMES = ["no_order", "small_order", "large_order", "reactivation"]              # event_id % 4
APP_SUBTYPES = {"signup": "session_start", "click": "screen_view", "purchase": "order_placed"}
N_REPS = 25                       # rep = custkey % 25
N_SUPPLIERS = 50                  # supplier = partkey % 50
CUSTOMER_CREATED_AT = "1994-12-01 00:00:00"
PO_CREATED_AT = "1994-12-01 00:00:00"
ORDER_HOUR_OFFSET_S = 8 * 3600    # orders start 08:00 ...
ORDER_SPREAD_S = 36000            # ... plus orderkey % 36000 seconds
SHIP_DAYS, DELIVER_DAYS, RETURN_DAYS = 2, 4, 10
RETURN_EVERY, CANCEL_EVERY = 20, 25
TERMS_DAYS = 30
PAY_BASE_DAYS, PAY_SPREAD_DAYS, RETRY_DAYS = 10, 60, 7
WRITE_OFF_DAYS, WRITE_OFF_OVERDUE = 180, 150
STOCKOUT_MIN_QTY = 45             # open lines above this quantity stock out
RESOLUTIONS = ["cancel_line"] * 5 + ["substitute"] * 3 + ["backorder"] * 2  # (orderkey + linenumber) % 10
ACTIVITY_SHIFT_DAYS = 8217        # driver events of January 2024 become the last month of the orders
BURST_EVERY, BURST_REST = 40, 3   # these customers place all their orders on one day ...
BURST_DAY = "1999-03-30"          # ... (bursts for the velocity rules)


def rep_of(custkey: Column) -> Column:
    return F.concat(F.lit("REP-"), F.lpad((custkey % N_REPS).cast("string"), 2, "0"))


def cust_id(custkey: Column) -> Column:
    return F.concat(F.lit("C-"), custkey.cast("string"))


def order_id(orderkey: Column) -> Column:
    return F.concat(F.lit("ORD-"), orderkey.cast("string"))


def sku_id(partkey: Column) -> Column:
    return F.concat(F.lit("SKU-"), partkey.cast("string"))


def payment_method_of(custkey: Column) -> Column:
    return pick(custkey % 6, PAYMENT_METHODS)


def demand_class(p_size: Column) -> Column:
    return F.when(p_size <= 17, "A").when(p_size <= 34, "B").otherwise("C")


def line_key(prefix: str | Column) -> Column:
    # (l_orderkey, l_linenumber) repeats in the driver data; widen with part and supplier
    return F.concat_ws("-", F.lit(prefix), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ---------------------------------------------------------------------------
# Domain frames (typed, before enveloping)
# ---------------------------------------------------------------------------
def customers_domain(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    seg = (
        F.when(F.col("c_mktsegment").isin(PREMIUM_MKT), "premium")
        .when(F.col("c_mktsegment").isin(REGULAR_MKT), "regular")
        .otherwise("low_volume")
    )
    k = F.col("c_custkey")
    # nation is a fixed 25-row dimension: broadcast is size-bounded by construction
    return c.join(F.broadcast(n.select("n_nationkey", "n_name")), c.c_nationkey == n.n_nationkey, "left").select(
        k.alias("custkey"),
        cust_id(k).alias("customer_id"),
        F.to_timestamp(F.lit(CUSTOMER_CREATED_AT)).alias("created_at"),
        seg.alias("segment"),
        (F.lit(100000.0) + F.lit(100.0) * F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("credit_limit"),
        pick(k % 3, ACQUISITION_CHANNELS).alias("acquisition_channel"),
        rep_of(k).alias("rep_id"),
        ((k % 2) == 0).alias("digital_active"),
        pick(k % 4, CUSTOMER_TYPES).alias("customer_type"),
        F.col("n_name").alias("area_id"),
        payment_method_of(k).alias("payment_method"),
        ((k % 100) / F.lit(100.0)).alias("risk_score"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("+20-"), F.lpad(k.cast("string"), 9, "0")).alias("phone"),
    )


def orders_domain(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    prio = F.substring("o_orderpriority", 1, 1)
    channel = F.coalesce(
        F.create_map(*[x for kv in CHANNEL_BY_PRIORITY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[prio],
        F.lit("organic"),
    )
    day = F.when(F.col("o_custkey") % BURST_EVERY == BURST_REST, F.lit(BURST_DAY).cast("timestamp")).otherwise(
        F.col("o_orderdate").cast("timestamp"))
    created = plus_micros(day, (F.lit(ORDER_HOUR_OFFSET_S) + k % ORDER_SPREAD_S) * 1_000_000)
    return o.select(
        k.alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        order_id(k).alias("order_id"),
        cust_id(F.col("o_custkey")).alias("customer_id"),
        created.alias("created_at"),
        F.col("o_totalprice").alias("total_value"),
        channel.alias("channel"),
        F.when(channel == "rep", rep_of(F.col("o_custkey"))).alias("rep_id"),
        ((k % 97) / F.lit(100.0)).alias("fraud_score"),
        F.col("o_orderstatus").alias("orderstatus"),
    )


def joined_lines(t: Tables) -> DataFrame:
    """One row per driver line item with its order's and its part's fields, as they are in the tables: what three branches
    of the log are derived from.  Texts are made after the join (``lines_domain``), so that it moves numbers."""
    li, p = t.lineitem, t.part
    o = orders_domain(t).select("orderkey", "custkey", "created_at", "orderstatus")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_discount", "l_quantity", "l_extendedprice")
    # the part first: where it is too large to broadcast, lines then lie by order at the end, as ``order_created`` groups them
    return (
        li.join(p.select("p_partkey", "p_size"), li.l_partkey == p.p_partkey, "left")
        .join(o, li.l_orderkey == o.orderkey)
        .select(*li.columns, "custkey", "created_at", "orderstatus", "p_size")
    )


def line_fields(f: Callable[[str], Column]) -> dict[str, Column]:
    """The fields of a line as an order event lists them (``ORDER_LINE``), from the joined columns ``f(name)``."""
    return {
        "sku_id": sku_id(f("l_partkey")),
        "quantity": f("l_quantity").cast("long"),
        "unit_price": f("l_extendedprice") / f("l_quantity"),
        "line_total": f("l_extendedprice"),
        "demand_class": demand_class(f("p_size")),
        "promotion_applied": f("l_discount") > 0,
        "discount_amount": f("l_extendedprice") * f("l_discount"),
    }


def lines_joined(t: Tables) -> DataFrame:
    """The joined lines; during a full log build they are stored once (``event_log``) and read by the three branches."""
    stored = t.__dict__.get("_lines")
    return joined_lines(t) if stored is None else stored


def lines_domain(t: Tables) -> DataFrame:
    """One row per driver line item with its order context (join on the order key)."""
    return lines_joined(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_discount",
        order_id(F.col("l_orderkey")).alias("order_id"), cust_id(F.col("custkey")).alias("customer_id"),
        "custkey", "created_at", "orderstatus", *[c.alias(n) for n, c in line_fields(F.col).items()],
    )


def promo_id(discount: Column) -> Column:
    return F.concat(F.lit("PROMO-"), F.round(discount * 100).cast("int").cast("string"))


# ---------------------------------------------------------------------------
# Event branches
# ---------------------------------------------------------------------------
def customer_created(t: Tables) -> DataFrame:
    c = customers_domain(t)
    fields = [
        "segment", "credit_limit", "acquisition_channel", "rep_id", "digital_active", "customer_type",
        "area_id", "payment_method", "risk_score", "name", "phone",
    ]
    return c.select(
        *envelope(
            "CustomerCreated",
            F.concat(F.lit("CC-"), F.col("custkey").cast("string")),
            F.col("customer_id"),
            F.col("created_at"),
            {f: F.col(f) for f in fields},
        )
    )


def order_heads(t: Tables) -> DataFrame:
    """OrderCreated with the fields that the order's own row gives (``eventlog.HEAD_FIELDS``): all but its lines and promotion."""
    return orders_domain(t).select(
        F.concat(F.lit("OC-"), F.col("orderkey").cast("string")).alias("event_id"),
        F.col("order_id").alias("aggregate_id"),
        F.col("created_at").alias("timestamp"),
        F.col("order_id").alias("correlation_id"),
        rec(**{f: F.col(f) for f in HEAD_FIELDS}).alias("OrderCreated"),
        "orderkey",
    )


def order_events(t: Tables) -> DataFrame:
    """OrderCreated with its fields as columns, not yet as text (``eventlog.DECODED``)."""
    stored = t.__dict__.get("_order_events")
    if stored is not None:
        return stored
    # one array per order (an order is one event); sorted so the payload is deterministic
    fields = line_fields(F.col)
    line = F.struct(*[fields[f.name].alias(f.name) for f in ORDER_LINE.fields])
    per_order = lines_joined(t).select("l_orderkey", "l_discount", line.alias("line")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.max("l_discount").alias("max_discount"),
    )
    o = order_heads(t)
    j = o.join(per_order, o.orderkey == per_order.l_orderkey, "left")
    empty = F.array().cast(T.ArrayType(ORDER_LINE))
    own = {f: F.col("OrderCreated")[f] for f in HEAD_FIELDS}
    own["lines"] = F.coalesce(F.col("lines"), empty)
    own["promotion_id"] = F.when(F.col("max_discount") > 0, promo_id(F.col("max_discount")))
    return j.select("event_id", "aggregate_id", "timestamp", "correlation_id",
                    rec(**{f: own[f] for f in REGISTRY["OrderCreated"].fieldNames()}).alias("OrderCreated"))


def order_created(t: Tables) -> DataFrame:
    return order_events(t).select(*order_envelope())


def order_status_events(t: Tables) -> DataFrame:
    o = orders_domain(t)
    k, st = F.col("orderkey"), F.col("orderstatus")
    oc = F.concat(F.lit("OC-"), k.cast("string"))
    # one row per (order, status event) via a literal array of candidates, filtered per rule
    none = F.lit(None).cast("string")
    cands = F.array(
        rec(et="OrderShipped", p="OS-", h=SHIP_DAYS * 24, on=st.isin("O", "F"), reason=none),
        rec(et="OrderDelivered", p="OD-", h=DELIVER_DAYS * 24, on=st == "F", reason=none),
        rec(et="OrderReturned", p="OR-", h=RETURN_DAYS * 24, on=(st == "F") & (k % RETURN_EVERY == 0),
            reason=F.lit("damaged")),
        rec(et="OrderCancelled", p="OX-", h=1, on=(st == "P") & (k % CANCEL_EVERY == 0),
            reason=F.lit("customer_request")),
    )
    e = o.select("*", F.explode(cands).alias("s")).filter("s.on")
    et = F.col("s.et")
    return e.select(
        *envelope(
            et,
            F.concat(F.col("s.p"), k.cast("string")),
            F.col("order_id"),
            plus_micros("created_at", F.col("s.h").cast("long") * 3_600_000_000),
            {
                "order_id": F.col("order_id"),
                "customer_id": F.col("customer_id"),
                "reason": F.col("s.reason"),
                "return_value": F.when(et == "OrderReturned", F.col("total_value")),
            },
            causation_id=oc,
            correlation_id=F.col("order_id"),
        )
    )


def _delivered(t: Tables) -> DataFrame:
    o = orders_domain(t).filter(F.col("orderstatus") == "F")
    return o.select(
        "*",
        F.concat(F.lit("INV-"), F.col("orderkey").cast("string")).alias("invoice_id"),
        plus_days("created_at", DELIVER_DAYS).alias("invoiced_at"),
        payment_method_of(F.col("custkey")).alias("payment_method"),
    )


def invoice_created(t: Tables) -> DataFrame:
    d = _delivered(t)
    return d.select(
        *envelope(
            "InvoiceCreated",
            F.concat(F.lit("IC-"), F.col("orderkey").cast("string")),
            F.col("invoice_id"),
            F.col("invoiced_at"),
            {
                "invoice_id": F.col("invoice_id"),
                "order_id": F.col("order_id"),
                "customer_id": F.col("customer_id"),
                "amount": F.col("total_value"),
                "due_date": F.date_format(plus_days("invoiced_at", TERMS_DAYS), "yyyy-MM-dd"),
                "terms_days": F.lit(TERMS_DAYS),
            },
            causation_id=F.concat(F.lit("OD-"), F.col("orderkey").cast("string")),
            correlation_id=F.col("order_id"),
        )
    )


def payment_events(t: Tables) -> DataFrame:
    """Captured / failed attempts and write-offs per delivered order, by order key modulo 10."""
    d = _delivered(t)
    k = F.col("orderkey")
    m = k % 10
    base = F.lit(PAY_BASE_DAYS) + k % PAY_SPREAD_DAYS
    r = RETRY_DAYS
    cands = F.array(
        rec(et="PaymentCaptured", n=1, d=base, on=m < 7),
        rec(et="PaymentFailed", n=1, d=base, on=m >= 7),
        rec(et="PaymentCaptured", n=2, d=base + r, on=m.isin(7, 8)),
        rec(et="PaymentFailed", n=2, d=base + r, on=m == 9),
        rec(et="PaymentFailed", n=3, d=base + 2 * r, on=m == 9),
        rec(et="CreditWrittenOff", n=0, d=F.lit(WRITE_OFF_DAYS).cast("long"), on=m == 9),
        # dunning after the first failed attempt: a collection case and a promise to pay at the retry
        rec(et="CollectionScheduled", n=1, d=base, on=m >= 7),
        rec(et="CollectionPromiseMade", n=1, d=base, on=m >= 7),
    )
    e = d.select("*", F.explode(cands).alias("s")).filter("s.on")
    et = F.col("s.et")
    abbrev = (F.when(et == "PaymentCaptured", "PC-").when(et == "PaymentFailed", "PF-")
              .when(et == "CollectionScheduled", "CS-").when(et == "CollectionPromiseMade", "CP-").otherwise("CW-"))
    return e.select(
        *envelope(
            et,
            F.concat(abbrev, k.cast("string"), F.lit("-"), F.col("s.n").cast("string")),
            F.when(et == "CreditWrittenOff", F.col("customer_id")).otherwise(F.col("invoice_id")),
            plus_days("invoiced_at", F.col("s.d")),
            {
                "invoice_id": F.col("invoice_id"),
                "customer_id": F.col("customer_id"),
                "amount": F.col("total_value"),
                "payment_method": F.when(et == "PaymentCaptured", F.col("payment_method")),
                "attempt_number": F.when(et.isin("PaymentCaptured", "PaymentFailed"), F.col("s.n")),
                "reason": F.when(et == "PaymentFailed", F.lit("insufficient_funds")),
                "days_overdue": F.when(et == "CreditWrittenOff", F.lit(WRITE_OFF_OVERDUE))
                .when(et == "CollectionScheduled", F.greatest(F.col("s.d") - TERMS_DAYS, F.lit(0))),
                "amount_due": F.when(et == "CollectionScheduled", F.col("total_value")),
                "promised_amount": F.when(et == "CollectionPromiseMade", F.col("total_value")),
                "promise_date": F.when(et == "CollectionPromiseMade", F.date_format(
                    plus_days("invoiced_at", F.col("s.d") + RETRY_DAYS), "yyyy-MM-dd")),
            },
            causation_id=F.concat(F.lit("IC-"), k.cast("string")),
            correlation_id=F.col("order_id"),
        )
    )


def purchase_events(t: Tables) -> DataFrame:
    """Purchase orders and receipts per part."""
    p = t.part
    pk = F.col("p_partkey")
    lead = F.lit(7) + pk % 14
    po_at = F.to_timestamp(F.lit(PO_CREATED_AT))
    po_id = F.concat(F.lit("PO-"), pk.cast("string"))
    supplier = F.concat(F.lit("SUP-"), F.lpad((pk % N_SUPPLIERS).cast("string"), 2, "0"))
    qty = (F.lit(1000) + F.col("p_size") * 10).cast("long")
    po = p.select(
        *envelope(
            "PurchaseOrderCreated", F.concat(F.lit("PO-"), pk.cast("string")), sku_id(pk), po_at,
            {"purchase_order_id": po_id, "sku_id": sku_id(pk), "supplier_id": supplier, "quantity": qty,
             "expected_lead_time_days": lead},
        )
    )
    received = p.select(
        *envelope(
            "StockReceived", F.concat(F.lit("SRC-"), pk.cast("string")), sku_id(pk),
            plus_days(po_at, lead + pk % 5),
            {"sku_id": sku_id(pk), "supplier_id": supplier, "purchase_order_id": po_id, "quantity": qty},
            causation_id=F.concat(F.lit("PO-"), pk.cast("string")),
        )
    )
    return po.unionByName(received)


def stock_events(t: Tables) -> DataFrame:
    """Reservations, releases and stockouts per line, in one pass over the lines."""
    li = lines_domain(t)
    k, q = F.col("l_orderkey"), F.col("quantity")
    closed = F.col("l_linestatus") == "F"
    # as ``order_status_events``: candidates of a line, filtered per rule
    cands = F.array(
        rec(et="StockReserved", p="SR", h=0, on=closed),
        rec(et="StockReleased", p="SL", h=1, on=closed & (F.col("orderstatus") == "P") & (k % CANCEL_EVERY == 0)),
        rec(et="StockoutOccurred", p="SO", h=0, on=(F.col("l_linestatus") == "O") & (q > STOCKOUT_MIN_QTY)),
    )
    e = li.select("*", F.explode(cands).alias("s")).filter("s.on")
    et = F.col("s.et")
    out = et == "StockoutOccurred"
    return e.select(
        *envelope(
            et, line_key(F.col("s.p")), F.col("sku_id"), plus_micros("created_at", F.col("s.h").cast("long") * 3_600_000_000),
            {"sku_id": F.col("sku_id"), "order_id": F.col("order_id"),
             "reason": F.when(et == "StockReleased", F.lit("order_cancelled")),
             "quantity": F.when(~out, q),
             "resolution": F.when(out, pick((k + F.col("l_linenumber")) % 10, RESOLUTIONS)),
             "requested_quantity": F.when(out, q),
             "available_quantity": F.when(out, q - 1 - k % STOCKOUT_MIN_QTY)},
            correlation_id=F.col("order_id"),
        )
    )


def replenishment(stockouts: DataFrame) -> DataFrame:
    """Purchase orders that follow backorders: on the first day of the next month each SKU orders 4/5 (rounded down, and 1) of
    what the month left open, delivered after its lead time.  ``stockouts(sku_id, timestamp, shortfall)``; returns
    ``sku_id, ref, po_at, received_at, quantity``."""
    month = F.trunc("timestamp", "month")
    per = stockouts.groupBy("sku_id", month.alias("month")).agg(F.sum("shortfall").cast("long").alias("open"))
    pk = F.substring_index("sku_id", "-", -1).cast("long")
    at = F.add_months("month", 1).cast("timestamp")
    return per.select(
        "sku_id", F.concat(F.lit("RPO-"), pk.cast("string"), F.lit("-"), F.date_format("month", "yyyyMM")).alias("ref"), at.alias("po_at"),
        plus_days(at, F.lit(7) + pk % 14 + pk % 5).alias("received_at"), (F.expr("open * 4 div 5") + 1).alias("quantity"),
    )


def promotion_applied(t: Tables) -> DataFrame:
    li = lines_domain(t).filter(F.col("l_discount") > 0)
    return li.select(
        *envelope(
            "PromotionApplied", line_key("PA"), promo_id(F.col("l_discount")), F.col("created_at"),
            {"promotion_id": promo_id(F.col("l_discount")), "order_id": F.col("order_id"),
             "customer_id": F.col("customer_id"), "discount_amount": F.col("discount_amount"),
             "original_value": F.col("line_total")},
            correlation_id=F.col("order_id"),
        )
    )


def activity_events(t: Tables) -> DataFrame:
    """Driver ``events``: view → rep visit, signup/click/purchase → app session, error → AppError."""
    ev = t.events.withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(ACTIVITY_SHIFT_DAYS)))
    uid, eid = F.col("user_id"), F.col("event_id")
    cid = cust_id(uid)
    visits = ev.filter(F.col("event_type") == "view").select(
        *envelope(
            "RepVisitCompleted", F.concat(F.lit("RV-"), eid.cast("string")), rep_of(uid), F.col("ts"),
            {"rep_id": rep_of(uid), "customer_id": cid, "outcome": pick(eid % 4, VISIT_OUTCOMES)},
        )
    )
    sub = F.create_map(*[x for kv in APP_SUBTYPES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    app = ev.filter(F.col("event_type").isin(list(APP_SUBTYPES))).select(
        *envelope(
            "AppSessionEvent", F.concat(F.lit("AS-"), eid.cast("string")), cid, F.col("ts"),
            {"customer_id": cid,
             "session_id": F.concat(F.lit("S-"), uid.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")),
             "event_subtype": sub[F.col("event_type")],
             "screen_name": F.concat(F.lit("screen-"), F.get_json_object("props", "$.k")),
             "search_query": F.lit(""),
             "session_duration_seconds": F.floor(F.col("value") * 10).cast("int"),
             "led_to_order": F.col("event_type") == "purchase"},
        )
    )
    errors = ev.filter(F.col("event_type") == "error").select(
        *envelope(
            "AppError", F.concat(F.lit("AE-"), eid.cast("string")), cid, F.col("ts"),
            {"customer_id": cid, "props": F.col("props")},
        )
    )
    return visits.unionByName(app).unionByName(errors)


def lifecycle_events(t: Tables) -> DataFrame:
    from ..operators.lifecycle import lifecycle_transitions

    o = orders_domain(t).select("customer_id", "created_at", "channel")
    c = customers_domain(t).select("customer_id", "created_at")
    tr = lifecycle_transitions(o, c)
    return tr.select(
        *envelope(
            F.col("event_type"),
            F.concat(F.lit("LC-"), F.col("customer_id"), F.lit("-"), F.col("event_type"), F.lit("-"),
                     F.unix_micros("timestamp").cast("string")),
            F.col("customer_id"),
            F.col("timestamp"),
            {"days_without_order": F.col("days_without_order"), "days_inactive": F.col("days_inactive"),
             "channel": F.col("channel")},
        )
    )


#: The log's parts, each stored without the others: their branches, those that read the lines, and the types they hold.
PARTS = {
    "customers": ([customer_created, lifecycle_events], 0, LIFECYCLE_TYPES),
    "orders": ([order_created], 1, ["OrderCreated"]),
    "statuses": ([order_status_events], 0, ORDER_STATUS_TYPES),
    "billing": ([invoice_created, payment_events], 0, ["InvoiceCreated", "PaymentCaptured", "PaymentFailed", "CreditWrittenOff",
                                                       "CollectionScheduled", "CollectionPromiseMade"]),
    "purchases": ([purchase_events], 0, ["PurchaseOrderCreated", "StockReceived"]),
    "stock": ([stock_events], 1, ["StockReserved", "StockReleased", "StockoutOccurred"]),
    "promotions": ([promotion_applied], 1, ["PromotionApplied"]),
    "activity": ([activity_events], 0, ["RepVisitCompleted", "AppSessionEvent", "AppError"]),
}


def parts_of(event_types: Iterable[str] | None = None) -> list[str]:
    """The parts that hold events of these types (default: all parts); a type that no part holds has no events."""
    wanted = None if event_types is None else set(event_types)
    return [p for p, (_, _, types) in PARTS.items() if wanted is None or wanted & set(types)]


def envelopes(t: Tables, parts: Iterable[str]) -> DataFrame:
    """``ENVELOPES`` of these parts of the log: every event, without its payload.  An order's lines are in its payload only, so
    they are not joined."""
    out = None
    for branch in (b for p in parts for b in PARTS[p][0]):
        own = order_heads(t).select(*order_envelope(False)) if branch is order_created else branch(t).select(*ENVELOPES)
        out = own if out is None else out.unionByName(own)
    return out


def event_log(t: Tables, keep: Callable[[DataFrame], DataFrame] | None = None, parts: Iterable[str] | None = None) -> DataFrame:
    """The log, or ``parts`` of it, as one union of branches (see the module docstring).

    With ``keep`` (the ingestion job; it stores a frame in the shared folder and returns it read back) the
    line-item join — the largest input, needed by three branches — is stored once instead of being
    shuffled by each; a single branch reads the join itself."""
    parts = list(PARTS if parts is None else parts)
    if keep is not None and sum(PARTS[p][1] for p in parts) > 1:
        t.__dict__["_lines"] = keep(joined_lines(t))
    branches = [branch(t) for p in parts for branch in PARTS[p][0]]
    log = branches[0]
    for b in branches[1:]:
        log = log.unionByName(b)
    return log


def build_log(spark, sf_dir: str) -> DataFrame:
    return event_log(Tables(spark, sf_dir))
