"""Acquisition funnel: ordered stages per customer, conversion and waiting times by cohort, and a survival curve of the
time to a stage with the customers that have not reached it as censored.

Customers are first reduced to one row with their stage times; all curves are over (cohort, whole days), so a cohort of any
size is a histogram bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_times(entered: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """``entered(customer_id, timestamp, cohort)`` with a time per stage of ``stages`` (name → ``(customer_id, timestamp)``): its
    first event at or after the stage before; null if there is none, and then for all later stages too.  Of repeated
    customers the earliest entry counts; rows without a customer or a time are left out."""
    ok = entered.filter("customer_id is not null and timestamp is not null")
    t = ok.groupBy("customer_id").agg(F.min(F.struct("timestamp", "cohort")).alias("_e")).select("customer_id", F.col("_e.cohort").alias("cohort"), F.col("_e.timestamp").alias("entered"))
    last = "entered"
    for name, events in stages.items():
        e = events.select("customer_id", F.col("timestamp").alias("_at"))
        first = t.select("customer_id", last).join(e, "customer_id").filter(F.col("_at") >= F.col(last)).groupBy("customer_id").agg(F.min("_at").alias(name))
        t, last = t.join(first, "customer_id", "left"), name
    return t


def _days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def conversion(times: DataFrame, stages: list[str]) -> DataFrame:
    """``cohort, stage, step, customers, conversion`` (of those at the stage before) and ``median_days`` from it (lower median of whole days)."""
    out, before = None, "entered"
    for step, name in enumerate(["entered", *stages]):
        d = times.groupBy("cohort", _days(F.col(name), F.col(before)).alias("days")).agg(F.count(name).alias("n"), F.count(before).alias("m"))
        upto = F.sum("n").over(Window.partitionBy("cohort").orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        d = d.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(Window.partitionBy("cohort")))
        median = F.min(F.when((F.col("n") > 0) & (F.col("_upto") * 2 >= F.col("_all")), F.col("days")))
        per = d.groupBy("cohort").agg(F.sum("n").alias("customers"), F.sum("m").alias("_from"), median.alias("median_days"))
        own = per.select("cohort", F.lit(name).alias("stage"), F.lit(step).alias("step"), "customers",
                         F.when(F.col("_from") > 0, F.col("customers") / F.col("_from")).alias("conversion"), "median_days")
        out, before = own if out is None else out.unionByName(own), name
    return out


def survival(times: DataFrame, stage: str, as_of: DataFrame) -> DataFrame:
    """Kaplan-Meier curve of the days from entry to ``stage``: ``cohort, day, at_risk, events, survival`` for the days with events.  Who has not
    reached it by ``as_of`` (one row) is censored there; who entered later is left out."""
    j = times.crossJoin(F.broadcast(as_of.select(F.col(as_of.columns[0]).alias("_now")))).filter("entered <= _now")  # one row
    hit = F.coalesce(F.col(stage) <= F.col("_now"), F.lit(False))
    d = j.select("cohort", _days(F.when(hit, F.col(stage)).otherwise(F.col("_now")), F.col("entered")).alias("day"), hit.cast("long").alias("hit"))
    d = d.groupBy("cohort", "day").agg(F.sum("hit").alias("events"), F.count("*").alias("n"))
    w = Window.partitionBy("cohort").orderBy("day")
    d = d.withColumn("at_risk", F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # a day on which all at risk have the event ends the curve at 0
    part = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(float("-inf")))
    d = d.withColumn("survival", F.exp(F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return d.filter("events > 0").select("cohort", "day", "at_risk", "events", "survival")
