"""M5–M7: windowed stream metrics with watermarks, and the late-arrival share.

The same ``window_metrics`` function builds the batch and the streaming aggregate; the stream
runs in append mode, so it emits exactly the windows the watermark has closed.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import data_files
from ..sources.keyed import scratch

ROWS_PER_FILE = 250_000
ROWS_PER_SLICE = 2_000_000  # of a stream whose state holds what a slice brings


def window_metrics(events: DataFrame, ts: str = "ts", width: str = "5 minutes", slide: str | None = None,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """M5: per window — events, value sum (exact cents) and p99 of value (approximate, mergeable)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("value_sum"),
        F.percentile_approx("value", 0.99, 1000).alias("value_p99"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
             "events", "value_sum", "value_p99")


def late_share(events: DataFrame, ts: str, arrival: str, delay_us: int) -> DataFrame:
    """M7: share of rows that arrive after the watermark had passed them
    (event time < max event time seen at an earlier arrival − delay)."""
    # the running maximum over arrivals is taken inside hours and carried on by one row per hour, so that an
    # arrival time of its own for each row is no single sorted task
    timed = isinstance(events.schema[arrival].dataType, (T.TimestampType, T.TimestampNTZType))
    hour = F.date_trunc("hour", F.col(arrival)) if timed else F.floor(F.col(arrival) / 4096)
    per = events.groupBy(arrival).agg(F.max(ts).alias("_max")).withColumn("_hour", hour)
    up_to_hour = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # one row per hour
    hours = per.groupBy("_hour").agg(F.max("_max").alias("_hmax")).select("_hour", F.max("_hmax").over(up_to_hour).alias("_before"))
    inside = Window.partitionBy("_hour").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = per.withColumn("_in", F.max("_max").over(inside)).join(hours, "_hour").select(
        arrival, F.greatest("_in", "_before").alias("_seen"))
    j = events.join(seen, arrival)
    late = F.unix_micros(ts) < (F.unix_micros("_seen") - F.lit(delay_us))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"),
                 (F.count_if(late) / F.count(F.lit(1))).alias("late_share"))


def write_time_sliced(df: DataFrame, path: str, ts: str, files: int, per_slice: int | None = None,
                      most_rows: int | None = None) -> int:
    """Write a table as ``files`` time slices for stream replay, one append per slice in time order.

    A file source picks the oldest files first, so slices written by one parallel job would be
    replayed in task-completion order and the watermark would drop earlier slices as late.  Each
    slice is its own write of ``per_slice`` files (default: as many as its rows need, so that no task
    holds a whole slice); read it back with ``maxFilesPerTrigger`` = the number returned, so one micro-batch
    is one slice.  With ``most_rows`` there are as many slices more as it takes for none to hold many more rows than
    that: a stateful stream holds in memory what its batches bring until the watermark has passed it, whatever the
    table's size.  The input is stored once (shared folder) so slicing does not recompute it; slice
    bounds come from ``approx_percentile`` (one row)."""
    spark = df.sparkSession
    with scratch(spark) as s:
        df = s.keep(df)
        if most_rows is not None:
            files = max(files, ceil(df.count() / most_rows))
        probs = [i / files for i in range(1, files)]
        b = df.agg(F.percentile_approx(F.unix_micros(ts), probs or [0.5], 10000).alias("b"), F.count(F.lit(1)).alias("n")).first()
        per_slice = per_slice or max(1, ceil(b["n"] / files / ROWS_PER_FILE))
        edges = [None] + sorted(set(int(x) for x in (b["b"] or [] if files > 1 else []))) + [None]
        t = F.unix_micros(ts)
        there = 0
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (t > F.lit(lo))
            if hi is not None:
                cond = cond & (t <= F.lit(hi))
            df.filter(cond).repartition(per_slice).write.mode("overwrite" if i == 0 else "append").parquet(path)
            # a slice of very few rows fills fewer files: empty ones keep the next slice out of its batch
            missing = there + per_slice - data_files(spark, path)
            for _ in range(missing):
                df.limit(0).coalesce(1).write.mode("append").parquet(path)
            there += per_slice
    return per_slice


def run_window_stream(spark: SparkSession, source: str, schema, out: str, checkpoint: str, ts: str = "ts",
                      watermark: str = "10 minutes", width: str = "5 minutes", slide: str | None = None,
                      by: tuple[str, ...] = (), files_per_trigger: int = 1):
    """M5/M6: append-mode windowed aggregate with a watermark, written as parquet."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    s = s.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    m = window_metrics(s, ts, width, slide, by)
    q = (m.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
