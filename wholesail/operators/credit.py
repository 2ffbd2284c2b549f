"""The sequential credit check and invoice dunning / ageing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_DAY
from .sequential import CHUNK, bounded_walk

MAX_FAILED_ATTEMPTS = 3
WRITE_OFF_DAYS = 180
AGEING_BUCKETS = [(0, "current"), (1, "1-30"), (31, "31-60"), (61, "61-90"), (91, "90+")]

UNITS_PER_CURRENCY = 10_000  # credit is counted in whole units of a hundredth of a cent


def credit_check(orders: DataFrame, releases: DataFrame, customers: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Accept an order if used + total ≤ limit; accepted orders add to used credit, their
    delivery or cancellation (the first after the order) releases it.  Releases sort before orders at one instant.

    orders(order_id, customer_id, created_at, total_value), releases(order_id, customer_id, timestamp); a customer
    without a limit has none to use.  The free credit is a bounded walk (``sequential``): an order takes from it, a
    release gives its order's amount back if that was accepted."""
    units = lambda c: F.round(F.col(c).cast("decimal(30,8)") * UNITS_PER_CURRENCY).cast("long")
    o = orders.select("customer_id", F.col("created_at").alias("ts"), F.lit("order").alias("kind"), "order_id",
                      F.col("total_value").cast("double").alias("value"), units("total_value").alias("amount"), F.lit(1).alias("_k"), F.lit(True).alias("take"))
    r = releases.select("customer_id", F.col("timestamp").alias("ts"), F.lit("release").alias("kind"), "order_id",
                        F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("amount"), F.lit(0).alias("_k"), F.lit(False).alias("take"))
    room = customers.select("customer_id", units("credit_limit").alias("room"))
    rows = o.unionByName(r).withColumn("tie", F.coalesce("order_id", F.lit("")))
    walked = bounded_walk(rows, "customer_id", ["ts", "_k", "order_id"], room, chunk, float(UNITS_PER_CURRENCY))
    return walked.select("customer_id", "ts", "kind", "order_id", F.col("value").alias("amount"), "accepted", F.col("taken").alias("used_after"))


def dunning(invoices: DataFrame, payments: DataFrame, writeoffs: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per invoice issued by ``as_of`` — failed attempts so far, paid / collection / written-off stage, days overdue at
    ``as_of`` (one-row frame) and the ageing bucket."""
    seen = payments.crossJoin(F.broadcast(as_of)).filter(F.col("timestamp") <= F.col("as_of"))  # one row
    p = seen.groupBy("invoice_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed_attempts"),
        F.min(F.when(F.col("status") == "paid", F.col("timestamp"))).alias("paid_at"))
    w = writeoffs.groupBy("invoice_id").agg(F.min("timestamp").alias("written_off_at"))
    j = invoices.select("invoice_id", "customer_id", "amount", "due_date", F.col("timestamp").alias("invoiced_at")) \
        .join(p, "invoice_id", "left").join(w, "invoice_id", "left").crossJoin(F.broadcast(as_of)) \
        .filter(F.col("invoiced_at") <= F.col("as_of"))
    fails = F.coalesce("failed_attempts", F.lit(0))
    paid = F.col("paid_at").isNotNull() & (F.col("paid_at") <= F.col("as_of"))
    wo = F.col("written_off_at").isNotNull() & (F.col("written_off_at") <= F.col("as_of"))
    stage = (F.when(paid, "paid").when(wo, "written_off").when(fails >= MAX_FAILED_ATTEMPTS, "collection")
             .when(F.to_date("as_of") > F.to_date("due_date"), "overdue").otherwise("open"))
    overdue = F.greatest(F.lit(0), F.datediff(F.to_date("as_of"), F.to_date("due_date")))
    bucket = F.lit(AGEING_BUCKETS[0][1])
    for lo, name in AGEING_BUCKETS[1:]:
        bucket = F.when(overdue >= lo, F.lit(name)).otherwise(bucket)
    age = (F.unix_micros("as_of") - F.unix_micros("invoiced_at")) / F.lit(float(MICROS_PER_DAY))
    return j.select("invoice_id", "customer_id", "amount", fails.cast("long").alias("failed_attempts"),
                    stage.alias("stage"), F.when(~paid & ~wo, overdue).otherwise(0).alias("days_overdue"),
                    F.when(~paid & ~wo, bucket).otherwise("closed").alias("ageing_bucket"),
                    ((age >= WRITE_OFF_DAYS) & ~paid & ~wo).alias("write_off_due"))


def promise_kept(promises: DataFrame, payments: DataFrame) -> DataFrame:
    """A promise is kept when the invoice is captured after the promise was made and no later
    than the promised date; returns promises, kept and the kept rate (one row)."""
    paid = payments.filter(F.col("status") == "paid").select("invoice_id", F.col("timestamp").alias("paid_at"))
    p = promises.select("event_id", "invoice_id", "promise_date", F.col("timestamp").alias("promised_at"))
    j = p.join(paid, "invoice_id", "left")
    hit = (F.col("paid_at") >= F.col("promised_at")) & (F.to_date("paid_at") <= F.to_date("promise_date"))
    per = j.groupBy("event_id").agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("kept"))
    return per.agg(F.count(F.lit(1)).alias("promises"), F.sum("kept").cast("long").alias("kept"),
                   (F.sum("kept") / F.count(F.lit(1))).alias("kept_rate"))
