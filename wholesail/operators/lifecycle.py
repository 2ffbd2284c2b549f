"""Customer lifecycle transitions re-aimed from a daily simulator check to a batch operator.

Rule kept: a customer is inactive after 60 days without an order, dormant after 150,
churned after 330 (terminal: nothing is emitted after the first churn).  An order that
arrives while inactive or dormant emits ``CustomerReactivated``.  Never-ordered customers
count from their creation time, not from a sentinel (SURVEY T23).

Skew: orders are first reduced to one row per (customer, day) — gaps inside a day can never
reach 60 days — so the per-customer window holds at most one row per calendar day, however
many orders a hot customer places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_DAY

# Fixed values (simulation_config lifecycle thresholds, days)
INACTIVE_DAYS, DORMANT_DAYS, CHURNED_DAYS = 60, 150, 330


def lifecycle_transitions(
    orders: DataFrame,
    customers: DataFrame,
    as_of: DataFrame | None = None,
    inactive: int = INACTIVE_DAYS,
    dormant: int = DORMANT_DAYS,
    churned: int = CHURNED_DAYS,
) -> DataFrame:
    """orders(customer_id, created_at, channel), customers(customer_id, created_at) →
    (customer_id, event_type, timestamp, days_without_order, days_inactive, channel).

    ``as_of`` is a one-row frame with column ``as_of``; default: the latest order time.
    """
    if as_of is None:
        as_of = orders.agg(F.max("created_at").alias("as_of"))
    day_rows = orders.groupBy("customer_id", F.to_date("created_at").alias("day")).agg(
        F.min("created_at").alias("first_ts"),
        F.max("created_at").alias("last_ts"),
        F.min_by("channel", F.struct("created_at", "channel")).alias("channel"),
    )
    created = customers.select(
        "customer_id", F.to_date("created_at").alias("day"), F.col("created_at").alias("first_ts"),
        F.col("created_at").alias("last_ts"), F.lit(None).cast("string").alias("channel"),
    )
    anchors = created.unionByName(day_rows)
    w = Window.partitionBy("customer_id").orderBy("first_ts", "last_ts")
    a = (
        anchors.withColumn("next_ts", F.lead("first_ts").over(w))
        .withColumn("next_channel", F.lead("channel").over(w))
        .crossJoin(F.broadcast(as_of))  # one row
        .withColumn("end_ts", F.coalesce("next_ts", "as_of"))
        .withColumn("gap", F.unix_micros("end_ts") - F.unix_micros("last_ts"))
    )
    D = MICROS_PER_DAY

    def crossing(name: str, days: int):
        return F.struct(
            F.lit(name).alias("event_type"),
            F.timestamp_micros(F.unix_micros("last_ts") + F.lit(days * D)).alias("timestamp"),
            F.lit(days).alias("days_without_order"),
            F.lit(None).cast("int").alias("days_inactive"),
            F.lit(None).cast("string").alias("channel"),
            (F.col("gap") >= days * D).alias("on"),
        )

    react = F.struct(
        F.lit("CustomerReactivated").alias("event_type"),
        F.col("next_ts").alias("timestamp"),
        F.lit(None).cast("int").alias("days_without_order"),
        F.call_function("div", F.col("gap"), F.lit(D)).cast("int").alias("days_inactive"),
        F.col("next_channel").alias("channel"),
        (F.col("next_ts").isNotNull() & (F.col("gap") >= inactive * D) & (F.col("gap") < churned * D)).alias("on"),
    )
    cands = F.array(
        crossing("CustomerBecameInactive", inactive),
        crossing("CustomerBecameDormant", dormant),
        crossing("CustomerChurned", churned),
        react,
    )
    tr = a.select("customer_id", F.explode(cands).alias("e")).filter("e.on").select(
        "customer_id", "e.event_type", "e.timestamp", "e.days_without_order", "e.days_inactive", "e.channel"
    )
    first_churn = F.min(F.when(F.col("event_type") == "CustomerChurned", F.col("timestamp"))).over(
        Window.partitionBy("customer_id")
    )
    return (
        tr.withColumn("_churn", first_churn)
        .filter(F.col("_churn").isNull() | (F.col("timestamp") <= F.col("_churn")))
        .drop("_churn")
    )
