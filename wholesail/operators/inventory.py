"""Inventory policy, elasticity, allocation, backorders, supplier lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_DAY
from .sequential import CHUNK, bounded_walk
from .windows import carried, running_extreme, running_sums

# Fixed values (inventory engine)
SERVICE_LEVEL_Z = 1.645
ORDER_COST, HOLDING_COST = 200.0, 10.0
EOQ_WITHOUT_DEMAND = 50
# Fixed values (elasticity engine): price elasticity by demand class
ELASTICITY = {"A": -0.3, "B": -0.6, "C": -1.2}


def daily_demand_stats(lines: DataFrame, day: Column) -> DataFrame:
    """Per SKU mean and sample std of daily demand over the full calendar, zero-filled.

    Days without sales enter as zeros through n (calendar days) — no zero rows are
    materialised: Σx, Σx² and n give mean and (n·Σx² − (Σx)²) / (n(n−1))."""
    d = lines.select("sku_id", "quantity", day.alias("_day"))
    span = d.agg(F.min("_day").alias("lo"), F.max("_day").alias("hi")).select(
        (F.datediff("hi", "lo") + 1).cast("long").alias("n_days"))
    per_day = d.groupBy("sku_id", "_day").agg(F.sum("quantity").cast("long").alias("q"))
    s = per_day.groupBy("sku_id").agg(F.sum("q").alias("sx"), F.sum(F.col("q") * F.col("q")).alias("sxx"))
    j = s.crossJoin(F.broadcast(span))  # one row
    n = F.col("n_days")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double") / (n * (n - 1)).cast("double")
    return j.select("sku_id", "n_days", (F.col("sx").cast("double") / n).alias("avg_daily_demand"),
                    F.sqrt(F.greatest(var, F.lit(0.0))).alias("demand_std"))


def safety_stock(lead: Column, std: Column, z: float = SERVICE_LEVEL_Z) -> Column:
    return F.lit(z) * F.sqrt(lead) * std


def reorder_point(avg: Column, lead: Column, std: Column, z: float = SERVICE_LEVEL_Z) -> Column:
    return avg * lead + safety_stock(lead, std, z)


def eoq(annual_demand: Column) -> Column:
    raw = F.floor(F.sqrt(F.lit(2.0) * annual_demand * F.lit(ORDER_COST) / F.lit(HOLDING_COST)))
    return F.when(annual_demand <= 0, F.lit(EOQ_WITHOUT_DEMAND)).otherwise(F.greatest(F.lit(1), raw.cast("long")))


def order_quantity(eoq_: Column, rop: Column, on_hand: Column, on_order: Column, ss: Column) -> Column:
    shortfall = rop - (on_hand + on_order)
    return F.greatest(F.lit(1), F.ceil(F.greatest(eoq_.cast("double"), shortfall + ss)).cast("long"))


def inventory_policy(lines: DataFrame, day: Column, lead_times: DataFrame, snapshot: DataFrame,
                     open_orders: DataFrame | None = None) -> DataFrame:
    """L5 + L6: policy per SKU and the reorder flag (on hand ≤ reorder point and no open PO)."""
    st = daily_demand_stats(lines, day)
    j = st.join(lead_times, "sku_id", "left").join(snapshot.select("sku_id", "estimated_on_hand"), "sku_id", "left")
    if open_orders is not None:
        j = j.join(open_orders.select("sku_id", "on_order"), "sku_id", "left")
    else:
        j = j.withColumn("on_order", F.lit(0))
    lead = F.coalesce(F.col("lead_time_days").cast("double"), F.lit(7.0))
    ss = safety_stock(lead, F.col("demand_std"))
    rop = reorder_point(F.col("avg_daily_demand"), lead, F.col("demand_std"))
    e = eoq(F.col("avg_daily_demand") * F.lit(365.0))
    on_hand = F.coalesce(F.col("estimated_on_hand"), F.lit(0)).cast("double")
    on_order = F.coalesce(F.col("on_order"), F.lit(0)).cast("double")
    return j.select(
        "sku_id", "avg_daily_demand", "demand_std", lead.alias("lead_time_days"), ss.alias("safety_stock"),
        rop.alias("reorder_point"), e.alias("eoq"), on_hand.alias("on_hand"),
        order_quantity(e, rop, on_hand, on_order, ss).alias("order_quantity"),
        ((on_hand <= rop) & (on_order <= 0)).alias("reorder"),
    )


def open_orders(orders: DataFrame, now: DataFrame) -> DataFrame:
    """``sku_id, on_order``: units ordered but not yet received at ``now`` (one row); an order without ``received_at`` is open.
    ``orders(sku_id, po_at, received_at, quantity)``."""
    o = orders.crossJoin(F.broadcast(now.select(F.col(now.columns[0]).alias("_now"))))  # one row
    o = o.filter((F.col("po_at") <= F.col("_now")) & (F.col("received_at").isNull() | (F.col("received_at") > F.col("_now"))))
    return o.groupBy("sku_id").agg(F.sum("quantity").cast("long").alias("on_order"))


def elastic_quantity(base_qty: Column, price_change: Column, demand_class: Column) -> Column:
    """max(1, round-half-even(base · (1 + ε·Δp))) with ε by demand class (unknown → B)."""
    eps = F.coalesce(F.create_map(*[x for k, v in ELASTICITY.items() for x in (F.lit(k), F.lit(v))])[demand_class],
                     F.lit(ELASTICITY["B"]))
    return F.greatest(F.lit(1), F.bround(base_qty * (F.lit(1.0) + eps * price_change), 0).cast("long"))


def allocate(receipts: DataFrame, demand: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per SKU in time order, a line is reserved if the level covers it, else it stocks out
    with the level as available quantity (later, smaller lines may still fit).

    receipts(sku_id, timestamp, ref, quantity), demand(sku_id, timestamp, ref, quantity);
    receipts sort before demand at the same instant.  A SKU's rows are walked in chunks (``sequential``)."""
    cols = ["sku_id", "timestamp", "ref", F.col("quantity").cast("long").alias("quantity")]
    rows = receipts.select(*cols, F.lit(0).alias("_k")).unionByName(demand.select(*cols, F.lit(1).alias("_k")))
    demanded = F.col("_k") == 1
    walked = bounded_walk(rows, "sku_id", ["timestamp", "_k", "ref", "quantity"], chunk=chunk, take=demanded, amount=F.col("quantity"))
    return walked.select("sku_id", "timestamp", F.when(demanded, "demand").otherwise("receipt").alias("kind"), "ref", "quantity",
                         F.col("accepted").alias("reserved"), F.col("room_before").alias("available_before"), F.col("room_after").alias("level_after"))


UNITS = 1024  # width of the buckets on a SKU's line of backordered units


def backorder_fulfilment(backorders: DataFrame, supply: DataFrame) -> DataFrame:
    """Which supply filled which backorder, and when.

    A backorder means that nothing was left, so it waits for stock that arrives from then on; waiting backorders are
    filled first come first served, in parts if need be, and supply that finds none waiting is not kept for
    later ones.  So the units waiting are a queue: with X the running balance of backordered minus supplied units,
    ``waiting = X - min(0, min X so far)``.  Demand and served supply are then two partitions of the same line of units
    (backordered so far, served so far); every cut between them is one fill.

    ``backorders(sku_id, timestamp, order_id, shortfall)``, ``supply(sku_id, timestamp, ref, quantity)``; supply comes first at one
    instant.  Returns ``sku_id, order_id, timestamp, shortfall, quantity, fulfilled_at, ref``, one row per fill, and one with
    null ``fulfilled_at`` for what is still open.  Rows of 0 units or less do not count.  All running figures are kept per
    (SKU, day) or per (SKU, ``UNITS`` units), never per SKU."""
    b = backorders.filter("shortfall > 0").select("sku_id", "timestamp", F.lit(1).alias("k"), F.col("order_id").alias("ref"), F.col("shortfall").cast("long").alias("n"))
    s = supply.filter("quantity > 0").select("sku_id", "timestamp", F.lit(0).alias("k"), "ref", F.col("quantity").cast("long").alias("n"))
    order = ["timestamp", "k", "ref", "n"]
    u = b.unionByName(s).withColumn("dd", F.when(F.col("k") == 1, F.col("n")).otherwise(0)).withColumn("dx", F.when(F.col("k") == 1, F.col("n")).otherwise(-F.col("n")))
    u = running_sums(u, "sku_id", order, {"d": "dd", "x": "dx"})
    u = running_extreme(u, "sku_id", order, "x", "low", smallest=True, before=True)
    waited = F.col("x") - F.col("dx") - F.least(F.lit(0), F.coalesce("low", F.lit(0)))
    u = u.withColumn("waited", waited)
    fill = F.struct(F.col("timestamp").alias("fulfilled_at"), F.col("ref"))
    fills = u.filter("k = 0 and waited > 0").select("sku_id", (F.col("d") - F.greatest(F.lit(0), F.col("waited") - F.col("n"))).alias("at"), fill.alias("fill"))
    need = F.struct(F.col("ref").alias("order_id"), "timestamp", F.col("n").alias("shortfall"))
    needs = u.filter("k = 1").select("sku_id", F.col("d").alias("at"), need.alias("need"))
    cuts = needs.unionByName(fills, allowMissingColumns=True).groupBy("sku_id", "at").agg(F.first("need", ignorenulls=True).alias("need"), F.first("fill", ignorenulls=True).alias("fill"))
    cuts = running_extreme(cuts, "sku_id", ["at"], "at", "from", bucket=F.expr(f"at div {UNITS}"), before=True)
    cuts = cuts.withColumn("back", -F.col("at"))  # the demand and the supply that a cut's units belong to end at or behind it
    cuts = carried(cuts, "sku_id", ["back"], ["need", "fill"], bucket=-F.expr(f"at div {UNITS}"))
    quantity = F.col("at") - F.coalesce("from", F.lit(0))
    return cuts.select("sku_id", "need.order_id", "need.timestamp", "need.shortfall", quantity.alias("quantity"), "fill.fulfilled_at", "fill.ref")


def stock_intervals(moves: DataFrame) -> DataFrame:
    """Stock of every SKU as validity intervals, one row per day on which it changed: ``sku_id, valid_from, valid_to`` (null: until
    today), ``on_hand`` (received so far), ``reserved`` (net of releases), ``available`` (the rest).
    ``moves(sku_id, timestamp, received, reserved, released)``, nulls count 0.

    Moves are added up by day first, so a SKU has at most one row a day and its window is bounded by the calendar."""
    day = moves.groupBy("sku_id", F.to_date("timestamp").alias("valid_from")).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("received", "reserved", "released")])
    w = Window.partitionBy("sku_id").orderBy("valid_from")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on_hand = F.sum("received").over(upto)
    reserved = F.sum(F.col("reserved") - F.col("released")).over(upto)
    return day.select("sku_id", "valid_from", F.date_sub(F.lead("valid_from").over(w), 1).alias("valid_to"), on_hand.alias("on_hand"),
                      reserved.alias("reserved"), (on_hand - reserved).alias("available"))


NO_DAY = -(1 << 31)  # the number of a missing day, which sorts before all others
LAST_DAY = (1 << 31) - 1


def _numbered(day: Column) -> Column:
    return F.coalesce(F.unix_date(day.cast("date")), F.lit(NO_DAY))


def stock_on_days(intervals: DataFrame, asked: DataFrame, stockouts: DataFrame) -> DataFrame:
    """Stock at the end of every ``asked(sku_id, day)``: ``sku_id, day, on_hand, reserved, available, stockouts, stockout``; 0 before a SKU's
    first move.  ``stockouts(sku_id, timestamp)`` are counted on the day itself.  ``day`` may be an array of days: SKUs are
    then not multiplied before they are moved.

    An as-of join in one shuffle: a SKU's days asked come before its changes (at most one of either kind a day), each change
    answers those that lie before the next one."""
    one = asked.schema["day"].dataType.typeName() != "array"
    days = F.array(_numbered(F.col("day"))) if one else F.transform("day", _numbered)
    asked = asked.select("sku_id", days.alias("days")).groupBy("sku_id").agg(F.flatten(F.collect_list("days")).alias("days"))
    stock = F.struct("on_hand", "reserved", "available")
    points = intervals.select("sku_id", _numbered(F.col("valid_from")).alias("at"), F.lit(0).alias("_k"), stock.alias("stock"))
    out = stockouts.groupBy("sku_id", _numbered(F.to_date("timestamp")).alias("at")).agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    u = points.unionByName(out, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("sku_id").orderBy("at", "_k")  # the days asked have no ``at``: they come first
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.select("sku_id", "at", "n", F.coalesce(F.lead("at").over(w), F.lit(LAST_DAY)).alias("until"),
                 F.last("stock", ignorenulls=True).over(upto).alias("stock"), F.first("days", ignorenulls=True).over(upto).alias("days"))
    since = F.coalesce("at", F.lit(NO_DAY))
    mine = F.filter("days", lambda d: (d >= since) & (d < F.col("until")))
    met = u.select("sku_id", "at", "n", "stock", F.explode(mine).alias("d"))
    n = F.coalesce(F.when(F.col("d") == F.col("at"), F.col("n")), F.lit(0))
    day = F.when(F.col("d") != NO_DAY, F.date_from_unix_date("d"))
    return met.select("sku_id", day.alias("day"), *[F.coalesce(f"stock.{c}", F.lit(0)).alias(c) for c in ("on_hand", "reserved", "available")], n.alias("stockouts"), (n > 0).alias("stockout"))


def supplier_lead_times(pos: DataFrame, receipts: DataFrame) -> DataFrame:
    """PO → receipt lead time and delay against the expected lead time, per supplier."""
    j = pos.select("purchase_order_id", "supplier_id", F.col("timestamp").alias("po_at"),
                   "expected_lead_time_days").join(
        receipts.select("purchase_order_id", F.col("timestamp").alias("received_at")), "purchase_order_id")
    lead = (F.unix_micros("received_at") - F.unix_micros("po_at")) / F.lit(float(MICROS_PER_DAY))
    d = j.select("supplier_id", lead.alias("lead"), (lead - F.col("expected_lead_time_days")).alias("delay"))
    return d.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("purchase_orders"), (F.sum("lead") / F.count("lead")).alias("avg_lead_days"),
        (F.sum("delay") / F.count("delay")).alias("avg_delay_days"), F.max("delay").alias("max_delay_days"))

