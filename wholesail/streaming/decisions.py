"""The decision → action chain as one Structured Streaming query.

Source: change records (``event_name`` INSERT/MODIFY/REMOVE, ``order_id``, ``new_image``)
arriving as parquet files; ``maxFilesPerTrigger`` sets the micro-batch size (M1).

Each micro-batch (``foreachBatch``) runs the same column functions as the batch path:
skip rules (J9) → score (J2–J6) → upsert decisions if absent (A11) → route + audit (J7–J8) →
upsert actions if absent → per-batch summary (J10).  Records whose amount is no number go to
a quarantine table and are not decided (M4).  Decisions and actions are keyed and anti-joined
against their targets, quarantine and summary are keyed by batch, and actions are derived from the
stored decisions: a batch repeated after a failure at any point ends in the same tables (M3).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.decision import audit, route, score
from ..sources import keyed

IMAGE = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("total_amount", T.StringType()),   # numbers arrive as text at the key-value boundary
    T.StructField("fraud_score", T.StringType()),
    T.StructField("avg_basket_90d", T.StringType()),
])
CHANGE_RECORD = T.StructType([
    T.StructField("event_name", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("approximate_ts", T.TimestampType()),
    T.StructField("new_image", IMAGE),
])
ACCEPTED_EVENTS = ("INSERT", "MODIFY")
SENTINELS = ("", "None", "nan", "null")


def clean(c):
    """Sentinel strings are absent values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*SENTINELS), F.lit(None)).otherwise(c)


def change_records(enriched: DataFrame) -> DataFrame:
    """Enriched orders → INSERT change records with text-typed numbers (as stored in a key-value table)."""
    img = F.struct(
        "order_id", "customer_id", "customer_segment", "payment_method",
        F.col("total_amount").cast("string").alias("total_amount"),
        F.col("fraud_score").cast("string").alias("fraud_score"),
        F.col("avg_basket_90d").cast("string").alias("avg_basket_90d"),
    )
    return enriched.select(F.lit("INSERT").alias("event_name"), "order_id",
                           F.col("created_at").alias("approximate_ts"), img.alias("new_image"))


def write_change_records(records: DataFrame, path: str, files: int) -> int:
    """Split the records into ``files`` time slices, written in time order (one micro-batch each
    with ``maxFilesPerTrigger`` = the number returned)."""
    from .metrics import write_time_sliced

    return write_time_sliced(records, path, "approximate_ts", files)


def upsert_if_absent(spark: SparkSession, batch: DataFrame, path: str, key: str, first_by: str, name: str) -> DataFrame:
    """Keep the first row per key in the batch (smallest ``first_by``), drop keys that other batches have written,
    write the rest as batch ``name`` (replacing what an earlier attempt at it wrote).  Rows without a key are not written.
    Only files that may hold one of the keys are looked at (``sources.keyed``).

    Returns the rows of the batch, read back from the target."""
    cols = batch.columns
    first = F.min_by(F.struct(*cols), F.struct(first_by, F.xxhash64(*[F.col(c).cast("string") for c in cols])))
    b = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_r")).select("_r.*").select(*cols)
    return keyed.claim(spark, b, path, key, name)


def record_id() -> Column:
    """The one rule for a record's order: the image's id, else the record's own."""
    return F.coalesce(clean(F.col("new_image")["order_id"]), clean(F.col("order_id")))


def skip_reasons(batch: DataFrame) -> DataFrame:
    """A ``skip_reason`` per record (null = to be processed)."""
    img = F.col("new_image")
    return batch.withColumn(
        "skip_reason",
        F.when(~F.coalesce(F.col("event_name").isin(*ACCEPTED_EVENTS), F.lit(False)), "wrong_event")
        .when(img.isNull(), "no_image")
        .when(record_id().isNull(), "no_order_id"),
    )


def typed_orders(batch: DataFrame) -> DataFrame:
    """The records to be processed, typed; ``malformed`` marks an amount that is there but is no number."""
    img = F.col("new_image")
    text = lambda c: clean(img[c])
    amount = text("total_amount").try_cast("double")
    return skip_reasons(batch).filter(F.col("skip_reason").isNull()).select(
        record_id().alias("order_id"), text("customer_id").alias("customer_id"), text("customer_segment").alias("customer_segment"),
        text("payment_method").alias("payment_method"), F.coalesce(amount, F.lit(0.0)).alias("total_amount"),
        text("fraud_score").try_cast("double").alias("fraud_score"),
        F.coalesce(text("avg_basket_90d").try_cast("double"), F.lit(0.0)).alias("avg_basket_90d"), "approximate_ts",
        img["total_amount"].alias("raw_amount"), (text("total_amount").isNotNull() & amount.isNull()).alias("malformed"),
    )


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out: str,
                  zero_is_missing: bool = True, stream: str = "") -> None:
    """One micro-batch, safe to repeat at any point: decisions and actions are keyed and a batch replaces its own; actions
    are derived from the stored decisions of the batch's orders, so those whose first attempt failed between the two
    writes get theirs; quarantine and summary belong to the batch too.  ``stream`` tells the batches of one stream from
    those of another with the same target."""
    base, name = out.rstrip("/"), f"{stream}-{batch_id}"
    with keyed.scratch(spark) as s:
        rows = s.keep(typed_orders(batch))
        bad = rows.filter("malformed").select("order_id", "customer_id", "raw_amount", "approximate_ts")
        bad = bad.withColumn("event_id", F.sha1(F.concat_ws("|", "order_id", "raw_amount", "approximate_ts"))).dropDuplicates(["event_id"])
        bad = s.keep(bad)
        errors = bad.count()
        if errors:
            keyed.claim(spark, bad.withColumn("batch_id", F.lit(batch_id)), f"{base}/quarantine", "event_id", name)
        # decision_at (J6) is the record's own time, so that a replay decides the same
        good = rows.filter(~F.col("malformed")).drop("malformed", "raw_amount").withColumnRenamed("approximate_ts", "decision_at")
        decided = score(good, zero_is_missing=zero_is_missing).withColumn("batch_id", F.lit(batch_id))
        mine = upsert_if_absent(spark, decided, f"{base}/decisions", "order_id", "decision_at", name)
        actions = audit(route(mine), actioned_at=F.col("decision_at")).withColumn("batch_id", F.lit(batch_id))
        upsert_if_absent(spark, actions, f"{base}/actions", "action_id", "actioned_at", name)
        # J10 summary: processed = orders this batch decided (in whichever attempt), errors = quarantined, skipped = rule skips and repeats
        n_decided, n = mine.count(), batch.count()
    summary = spark.createDataFrame([(n_decided, n - n_decided - errors, errors)], "processed long, skipped long, errors long")
    summary.coalesce(1).write.mode("overwrite").parquet(f"{base}/summaries/stream=s{stream}/batch_id={batch_id}")


def run_decisions(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_trigger: int = 1,
                  zero_is_missing: bool = True):
    """Start the chain with ``availableNow`` (process what is there, then stop) and wait for it."""
    from ..session import checkpoint_dir

    checkpoint_dir(spark)
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    source_rows = (spark.readStream.schema(CHANGE_RECORD).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source))
    q = (source_rows.writeStream.foreachBatch(
        lambda df, bid: process_batch(spark, df, bid, out, zero_is_missing, stream))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
