"""Simulator rules re-aimed as features over the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_DAY, MICROS_PER_HOUR
from .joins import null_safe_join
from .windows import cumulative_at, running_sums

# Fixed values (fraud engine / monitor configuration)
VELOCITY_THRESHOLD = 3
AMOUNT_MULTIPLIER = 5.0
HIGH_RISK_THRESHOLD, REJECT_THRESHOLD = 0.8, 0.9
REACTIVATION_DAYS = 30
HISTORY_ORDERS = 90
# Fixed values (ordering engine): base daily order rate by segment, month seasonality
BASE_RATES = {"premium": 0.12, "regular": 0.07, "low_volume": 0.02, "new_30d": 0.15}
SEASONALITY_BOOST = {1: 0.85, 2: 0.90, 3: 1.20, 4: 1.30, 5: 1.00, 6: 1.20, 7: 1.40, 8: 1.45,
                     9: 1.30, 10: 1.05, 11: 0.95, 12: 1.00}
# Fixed values (payment engine): success probability by customer risk
RISK_TIERS = [(0.3, 0.95), (0.7, 0.70)]
RISK_TIER_ELSE = 0.40


def previous_n_mean(orders: DataFrame, key: str, ts: str, oid: str, value: str, n: int = HISTORY_ORDERS) -> DataFrame:
    """Mean of the key's previous ``n`` orders (0 without history).

    Sum of rows r−n … r−1 = S(r−1) − S(r−n−1) with S a running sum; S(r−n−1) is fetched with an
    equi-join on (key, position), so no window ever spans a whole key."""
    d = orders.select(key, ts, oid, F.col(value).cast("decimal(20,2)").alias("_v"), F.lit(1).alias("_one"))
    d = running_sums(d, key, [ts, oid], {"_seq": "_one", "_S": "_v"})
    back = d.select(key, (F.col("_seq") + n + 1).alias("_seq"), F.col("_S").alias("_Sback"))  # S(r − n − 1)
    j = null_safe_join(d, back, [key, "_seq"], "left")
    prev_sum = (F.col("_S") - F.col("_v")) - F.coalesce(F.col("_Sback"), F.lit(0))
    cnt = F.least(F.col("_seq") - 1, F.lit(n))
    mean = F.when(cnt > 0, prev_sum.cast("double") / cnt).otherwise(F.lit(0.0))
    return j.select(oid, mean.alias("avg_prev"), F.col("_seq").alias("order_seq"))


def fraud_score(count_24h: Column, value: Column, avg_90: Column, risk: Column,
                velocity_threshold: int = VELOCITY_THRESHOLD, multiplier: float = AMOUNT_MULTIPLIER) -> Column:
    """L3: velocity and amount-spike signals plus profile risk, capped at 1."""
    velocity = F.when(count_24h >= velocity_threshold,
                      F.least(F.lit(1.0), F.lit(0.4) + (count_24h - velocity_threshold) * F.lit(0.1))).otherwise(0.0)
    spike = (avg_90 > 0) & (value > avg_90 * F.lit(multiplier))
    amount = F.when(spike, F.least(F.lit(1.0), F.lit(0.3) + (value / (avg_90 * F.lit(multiplier)) - 1) * F.lit(0.2))
                    ).otherwise(0.0)
    combined = velocity * F.lit(0.5) + amount * F.lit(0.4) + (risk * F.lit(0.3)) * F.lit(0.1)
    return F.least(F.lit(1.0), combined)


def order_features(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """L1–L3 per order: 24 h velocity (before this order), mean of the previous 90 orders,
    true 90-day mean, and the fraud score the order would get.

    Both trailing windows come from ONE ``cumulative_at`` pass with three probes per order
    (t−1µs, t−24h−1µs, t−90d−1µs): count and sum in [t−W, t) are differences of two probes."""
    o = orders.select("order_id", "customer_id", "created_at", "total_value")
    t = F.unix_micros("created_at")
    probes = o.select("customer_id", F.explode(F.array(
        F.struct(F.struct("order_id", F.lit("a").alias("tag")).alias("pid"), (t - 1).alias("at")),
        F.struct(F.struct("order_id", F.lit("b").alias("tag")).alias("pid"), (t - F.lit(24 * MICROS_PER_HOUR) - 1).alias("at")),
        F.struct(F.struct("order_id", F.lit("c").alias("tag")).alias("pid"), (t - F.lit(90 * MICROS_PER_DAY) - 1).alias("at")),
    )).alias("p")).select("customer_id", "p.pid", "p.at")
    c = cumulative_at(o, probes, "customer_id", "created_at", F.col("at"), "pid",
                      value=F.col("total_value").cast("decimal(20,2)"))
    c = c.select("pid.order_id", "pid.tag", "_cnt", "_sum")

    def pick(tag, col):
        return F.max(F.when(F.col("tag") == tag, F.col(col)))

    w = c.groupBy("order_id").agg(pick("a", "_cnt").alias("ca"), pick("b", "_cnt").alias("cb"),
                                  pick("c", "_cnt").alias("cc"), pick("a", "_sum").alias("sa"),
                                  pick("c", "_sum").alias("sc"))
    n90 = F.col("ca") - F.col("cc")
    feats = w.select("order_id", (F.col("ca") - F.col("cb")).alias("velocity_24h"),
                     F.when(n90 > 0, (F.col("sa") - F.col("sc")).cast("double") / n90).otherwise(F.lit(0.0))
                     .alias("mean_90d"))
    prev = previous_n_mean(o, "customer_id", "created_at", "order_id", "total_value")
    risk = customers.select("customer_id", F.col("risk_score").alias("_risk"))
    j = o.join(feats, "order_id").join(prev, "order_id").join(risk, "customer_id", "left")
    return j.select(
        "order_id", "customer_id", "velocity_24h", "avg_prev", "mean_90d",
        fraud_score(F.col("velocity_24h"), F.col("total_value"), F.col("avg_prev"),
                    F.coalesce("_risk", F.lit(0.0))).alias("fraud_model_score"),
    )


def fraud_windows(orders: DataFrame, customers: DataFrame, window: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """L4/M6: per customer and sliding 24 h window (every 6 h), order count and the monitor score.

    The monitor scores with the customer's history mean as both value and baseline, so only the
    velocity and profile terms can fire; alerts are the windows at or above 0.8."""
    w = orders.groupBy("customer_id", F.window("created_at", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("orders"))
    risk = customers.select("customer_id", F.col("risk_score").alias("_risk"))
    j = w.join(risk, "customer_id", "left")
    score = fraud_score(F.col("orders"), F.lit(1.0), F.lit(1.0), F.coalesce("_risk", F.lit(0.0)))
    return j.select(
        "customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "orders",
        score.alias("score"),
        F.when(score >= REJECT_THRESHOLD, "rejected").when(score >= HIGH_RISK_THRESHOLD, "flagged").alias("action"),
        F.when(F.col("orders") >= VELOCITY_THRESHOLD, "velocity").otherwise("amount_spike").alias("fraud_type"),
    )


def fraud_alerts(features: DataFrame, at_least: float = HIGH_RISK_THRESHOLD) -> DataFrame:
    """L4: orders of ``order_features`` whose model score reaches the alert threshold, with what is done about them
    and which signal it was."""
    score = F.col("fraud_model_score")
    return features.filter(score >= at_least).select(
        "order_id", "customer_id", F.round(score, 4).alias("fraud_score"),
        F.when(score >= REJECT_THRESHOLD, "rejected").otherwise("flagged").alias("action"),
        F.when(F.col("velocity_24h") >= VELOCITY_THRESHOLD, "velocity").otherwise("amount_spike").alias("fraud_type"))


def payment_success_probability(risk: Column) -> Column:
    """<.3 → .95, <.7 → .70, else .40."""
    out = F.lit(RISK_TIER_ELSE)
    for bound, p in reversed(RISK_TIERS):
        out = F.when(risk < bound, F.lit(p)).otherwise(out)
    return out


def category_lift(lines: DataFrame, category: str = "demand_class") -> DataFrame:
    """Lift of category pairs inside baskets: P(a∧b) / (P(a)·P(b)).

    Each order is first reduced to its distinct categories (bounded by the number of
    categories), so the pairs per order are bounded by a constant, not by basket size."""
    oc = lines.select("order_id", category).distinct()
    n = oc.select("order_id").distinct().agg(F.count(F.lit(1)).alias("N"))
    per_order = oc.groupBy("order_id").agg(F.array_sort(F.collect_set(category)).alias("cats"))
    pairs = per_order.select(F.explode(F.filter(
        F.flatten(F.transform("cats", lambda a: F.transform("cats", lambda b: F.struct(a.alias("a"), b.alias("b"))))),
        lambda p: p["a"] < p["b"])).alias("p")).groupBy(F.col("p.a").alias("cat_a"), F.col("p.b").alias("cat_b")).agg(
        F.count(F.lit(1)).alias("both"))
    single = oc.groupBy(category).agg(F.count(F.lit(1)).alias("cnt"))
    sa = single.select(F.col(category).alias("cat_a"), F.col("cnt").alias("n_a"))
    sb = single.select(F.col(category).alias("cat_b"), F.col("cnt").alias("n_b"))
    j = pairs.join(sa, "cat_a").join(sb, "cat_b").crossJoin(F.broadcast(n))  # n: one row
    lift = (F.col("both").cast("double") * F.col("N")) / (F.col("n_a").cast("double") * F.col("n_b"))
    return j.select("cat_a", "cat_b", "both", "n_a", "n_b", lift.alias("lift"))


def session_funnel(app_events: DataFrame) -> DataFrame:
    """Per session — views, searches, duration, whether it led to an order.

    Events without a session id are of one session while their customer pauses for less than 30 minutes (those
    without a time either: one per customer)."""
    timed = F.col("session_id").isNull() & F.col("timestamp").isNotNull()
    figures = [
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_subtype") == "screen_view").alias("views"),
        F.count_if(F.col("event_subtype") == "product_search").alias("searches"),
        F.sum("session_duration_seconds").cast("long").alias("duration_seconds"),
        F.max(F.col("led_to_order").cast("int")).cast("boolean").alias("led_to_order"),
        F.min("timestamp").alias("started_at"),
    ]
    named = app_events.filter(~timed).groupBy("session_id", "customer_id").agg(*figures)
    paused = app_events.filter(timed).groupBy("session_id", "customer_id", F.session_window("timestamp", "30 minutes")).agg(*figures)
    return named.unionByName(paused.drop("session_window"))


def visit_gaps(visits: DataFrame, overdue_days: int = 30) -> DataFrame:
    """Days since the previous visit of the same rep to the same customer; overdue > 30 d.

    ``lag`` runs per (rep, customer, day); the first visit of a day looks back to the last one of the pair's
    earlier days, of which there is one row each.  Null reps and customers are values of their own."""
    pair = ["rep_id", "customer_id"]
    v = visits.select("event_id", *pair, "timestamp", "outcome", F.date_trunc("day", "timestamp").alias("_day"))
    last = v.groupBy(*pair, "_day").agg(F.max("timestamp").alias("_last"))
    earlier = last.select(*pair, "_day", F.lag("_last").over(Window.partitionBy(*pair).orderBy("_day")).alias("_earlier"))
    same_day = F.lag("timestamp").over(Window.partitionBy(*pair, "_day").orderBy("timestamp", "event_id"))
    j = null_safe_join(v.withColumn("_same", same_day), earlier, [*pair, "_day"])
    gap = (F.unix_micros("timestamp") - F.unix_micros(F.coalesce("_same", "_earlier"))) / F.lit(float(MICROS_PER_DAY))
    return j.select("event_id", "rep_id", "customer_id", "timestamp", "outcome", gap.alias("days_since_last"),
                    (gap > overdue_days).alias("overdue"))


def visit_outcome_mix(visits: DataFrame, customers: DataFrame) -> DataFrame:
    """Visit outcome mix by customer tier (segment)."""
    j = visits.join(customers.select("customer_id", "segment"), "customer_id", "left")
    return j.groupBy(F.coalesce("segment", F.lit("unknown")).alias("segment"), "outcome").agg(
        F.count(F.lit(1)).alias("visits"))


def channel_attribution(orders: DataFrame, visits: DataFrame, days: int = 7) -> DataFrame:
    """An order is rep-attributed when its customer had a visit in the 7 days before it.

    As-of existence = visits counted at the order time minus visits counted 7 days earlier."""
    o = orders.select("order_id", "customer_id", "created_at", "channel")
    v = visits.select("customer_id", F.col("timestamp").alias("created_at"))
    t = F.unix_micros("created_at")
    a = cumulative_at(v, o, "customer_id", "created_at", t, "order_id").select("order_id", F.col("_cnt").alias("_a"))
    b = cumulative_at(v, o, "customer_id", "created_at", t - F.lit(days * MICROS_PER_DAY) - 1, "order_id").select(
        "order_id", F.col("_cnt").alias("_b"))
    j = o.join(a, "order_id").join(b, "order_id")
    recent = (F.col("_a") - F.col("_b")) > 0
    return j.select("order_id", "customer_id", "channel", (F.col("_a") - F.col("_b")).alias("visits_7d"),
                    F.when(recent, "rep").otherwise(F.col("channel")).alias("attributed_channel"))


def order_propensity(customers: DataFrame, orders: DataFrame, as_of: DataFrame, promo_segments: list[str] | None = None,
                     visits: DataFrame | None = None, reactivations: DataFrame | None = None) -> DataFrame:
    """logistic(base·recency·season + 0.2·promo + 0.3·visit) per customer at ``as_of`` (a one-row frame
    with column ``as_of``).

    recency is raised by half within 30 days of a reactivation (``reactivations(customer_id, timestamp)``); the
    promotion boost needs a targeted segment, the visit boost a visit of the customer's own rep in the last
    7 days (``visits(customer_id, rep_id, timestamp)``)."""
    last = orders.groupBy("customer_id").agg(F.max("created_at").alias("last_order"))
    c = customers.select("customer_id", "segment", "rep_id").join(last, "customer_id", "left").crossJoin(F.broadcast(as_of))
    days = (F.unix_micros("as_of") - F.unix_micros("last_order")) / F.lit(float(MICROS_PER_DAY))
    days = F.coalesce(days, F.lit(9999.0))
    recency = F.when(days < 7, 1.2).when(days > 60, 0.1).when(days > 30, 0.5).otherwise(1.0)

    def recent(events: DataFrame, keys: list[str], n_days: int, flag: str) -> DataFrame:
        at = events.crossJoin(F.broadcast(as_of)).filter(
            (F.col("timestamp") <= F.col("as_of")) & (F.col("timestamp") >= F.col("as_of") - F.make_dt_interval(F.lit(n_days))))
        return at.select(*keys).distinct().withColumn(flag, F.lit(True))

    boosted = visited = F.lit(False)
    if reactivations is not None:
        c = c.join(recent(reactivations, ["customer_id"], REACTIVATION_DAYS, "_back"), "customer_id", "left")
        boosted = F.coalesce("_back", F.lit(False))
    if visits is not None:
        c = c.join(recent(visits, ["customer_id", "rep_id"], 7, "_seen"), ["customer_id", "rep_id"], "left")
        visited = F.coalesce("_seen", F.lit(False))
    recency = F.when(boosted, recency * 1.5).otherwise(recency)
    base = F.coalesce(F.create_map(*[x for k, v in BASE_RATES.items() for x in (F.lit(k), F.lit(v))])[F.col("segment")],
                      F.lit(BASE_RATES["regular"]))
    season = F.create_map(*[x for k, v in SEASONALITY_BOOST.items() for x in (F.lit(k), F.lit(v))])[F.month("as_of")]
    promo = F.when(F.col("segment").isin(promo_segments or []), 0.2).otherwise(0.0)
    linear = base * recency * season + promo + F.when(visited, 0.3).otherwise(0.0)
    return c.select("customer_id", "segment", days.alias("days_since_order"),
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).alias("p_order"))


def price_index(daily_delta: DataFrame, day: str = "day", delta: str = "delta") -> DataFrame:
    """Cumulative product of (1 + delta) = exp(Σ log1p(delta)) in day order.

    The window runs over one row per day (bounded by the calendar)."""
    from pyspark.sql import Window

    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily_delta.select(day, delta, F.exp(F.sum(F.log1p(delta)).over(w)).alias("index"))

