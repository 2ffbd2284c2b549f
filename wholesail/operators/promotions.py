"""L9 (+D11, F12): promotion eligibility, discount and best promotion per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import broadcast_if_small

BOGO_SHARE = 0.5


def discount_amount(total: Column, ptype: Column, value: Column) -> Column:
    """percentage/price_discount: total·v/100; fixed: v; bogo: half — discounted total floored at 0."""
    discounted = (F.when(ptype.isin("percentage", "price_discount"),
                         F.greatest(F.lit(0.0), total * (F.lit(1.0) - value / F.lit(100.0))))
                  .when(ptype == "fixed", F.greatest(F.lit(0.0), total - value))
                  .otherwise(total * F.lit(BOGO_SHARE)))
    return F.greatest(F.lit(0.0), total - discounted)


def promotion_calendar(applied: DataFrame) -> DataFrame:
    """Promotion definitions re-derived from redemptions: percentage = the id's number, active
    between its first and last redemption day, open to every segment (no targeting recorded)."""
    return applied.groupBy("promotion_id").agg(
        F.to_date(F.min("timestamp")).alias("start_day"), F.to_date(F.max("timestamp")).alias("end_day")
    ).select("promotion_id", F.lit("percentage").alias("promotion_type"),
             F.regexp_extract("promotion_id", r"(\d+)$", 1).cast("double").alias("value"),
             "start_day", "end_day", F.lit(None).cast("array<string>").alias("target_segments"))


def best_promotion(orders: DataFrame, customers: DataFrame, promotions: DataFrame) -> DataFrame:
    """eligible = active on the order day and (no target or segment targeted); best = largest
    discount (strictly > 0, first id on ties); orders whose discounted total would be ≤ 0 are rejected.

    The interval condition start ≤ day ≤ end becomes an equi-join: each promotion is expanded
    to its active days (rows = Σ active days, bounded by the calendar) and joined on the day, so
    no nested-loop or cartesian join is ever planned; the expanded calendar is broadcast only
    under a checked size."""
    o = orders.select("order_id", "customer_id", "created_at", "total_value").join(
        customers.select("customer_id", "segment"), "customer_id", "left").withColumn("_day", F.to_date("created_at"))
    days = promotions.select("*", F.explode(F.sequence("start_day", "end_day")).alias("_day"))
    j = o.join(broadcast_if_small(days), "_day", "left")
    eligible = F.col("promotion_id").isNotNull() & (
        F.col("target_segments").isNull() | (F.size("target_segments") == 0)
        | F.array_contains(F.coalesce("target_segments", F.array().cast("array<string>")), F.col("segment")))
    d = discount_amount(F.col("total_value"), F.col("promotion_type"), F.col("value"))
    c = j.withColumn("_d", F.when(eligible, d)).withColumn("_ok", F.col("_d") > 0)
    best = c.groupBy("order_id", "total_value").agg(
        F.min_by(F.col("promotion_id"), F.when(F.col("_ok"), F.struct(-F.col("_d"), F.col("promotion_id")))).alias("best_id"),
        F.max(F.when(F.col("_ok"), F.col("_d"))).alias("best_discount"))
    return best.select(
        "order_id", F.when(F.col("best_discount").isNotNull(), F.col("best_id")).alias("promotion_id"),
        F.coalesce("best_discount", F.lit(0.0)).alias("discount_amount"),
        (F.col("total_value") - F.coalesce("best_discount", F.lit(0.0))).alias("discounted_total"),
        ((F.col("total_value") - F.coalesce("best_discount", F.lit(0.0))) <= 0).alias("rejected"))


def fitting_rules(orders: DataFrame, attributes: dict[str, Column], rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """The rules that fit each order: ``orders`` columns, ``promotion_id``, ``promotion_type``, ``value``.

    A rule names values for any number of scopes (``conditions(promotion_id, scope, scope_value)``); it fits when every scope it
    names holds the order's value (``attributes``: scope → column), and on days between ``start_day`` and ``end_day`` of
    ``rules(promotion_id, promotion_type, value, start_day, end_day)``.  A rule without conditions fits every order of its days.

    Relational division over an inverted index: an order has one row per scope, meets the conditions on (scope, value), and the
    rules of which it met as many scopes as they name are left.  Rules that share no value with an order never meet it."""
    named = conditions.filter("scope_value is not null").select("promotion_id", "scope", "scope_value").distinct()
    needs = conditions.groupBy("promotion_id").agg(F.countDistinct("scope").alias("_need"))
    index = named.join(needs, "promotion_id")
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), v.cast("string").alias("scope_value")) for k, v in attributes.items()])
    o = orders.withColumn("_day", F.to_date("created_at"))
    facets = o.select("order_id", F.explode(scopes).alias("_s")).select("order_id", "_s.scope", "_s.scope_value")
    met = facets.join(broadcast_if_small(index), ["scope", "scope_value"])
    full = met.groupBy("order_id", "promotion_id").agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
    scoped = full.filter(F.col("_n") == F.col("_need")).select("order_id", "promotion_id")
    inside = (F.col("_day") >= F.col("start_day")) & (F.col("_day") <= F.col("end_day"))
    one = o.join(scoped, "order_id").join(broadcast_if_small(rules), "promotion_id").filter(inside)
    free = rules.join(needs, "promotion_id", "left_anti").withColumn("_day", F.explode(F.sequence("start_day", "end_day")))
    every = o.join(broadcast_if_small(free), "_day")
    columns = [*orders.columns, "promotion_id", "promotion_type", "value"]
    return one.select(*columns).unionByName(every.select(*columns))


def best_fitting(orders: DataFrame, attributes: dict[str, Column], rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """L9 with targets of several scopes: ``order_id, fitting`` (rules that fit), the best of them (largest discount above 0, first id
    on ties) with ``promotion_type, discount_amount, discounted_total``, and ``rejected`` where nothing would be left to pay."""
    fit = fitting_rules(orders, attributes, rules, conditions)
    d = discount_amount(F.col("total_value"), F.col("promotion_type"), F.col("value"))
    best = F.min_by(F.struct("promotion_id", "promotion_type", "_d"), F.when(F.col("_d") > 0, F.struct(-F.col("_d"), F.col("promotion_id"))))
    per = fit.withColumn("_d", d).groupBy("order_id").agg(F.count("*").alias("fitting"), best.alias("b"), F.max("_d").alias("_top"))
    j = orders.select("order_id", "total_value").join(per, "order_id", "left")
    some = F.coalesce(F.col("_top") > 0, F.lit(False))
    off = F.when(some, F.col("b._d")).otherwise(F.lit(0.0))
    left = F.col("total_value") - off
    return j.select("order_id", F.coalesce("fitting", F.lit(0)).alias("fitting"), F.when(some, F.col("b.promotion_id")).alias("promotion_id"),
                    F.when(some, F.col("b.promotion_type")).alias("promotion_type"), off.alias("discount_amount"), left.alias("discounted_total"),
                    (left <= 0).alias("rejected"))
