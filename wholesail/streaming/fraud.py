"""M8: the fraud features of ``operators.features`` (L1–L3) in a stream, from recent orders kept as state.

State per customer is a list of its orders' times and values, cut after every batch to what a later order can
still ask for: the last 24 hours, and the last 90 orders.  A customer's orders of a micro-batch are walked in time order, and
every order comes out once, with the features it had when it arrived.

A call to a Python state function costs milliseconds, whatever it does, so customers are grouped into buckets by hash: a call
walks all customers of a bucket, and the bucket's state is one Arrow table (``buckets.pack``)."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import MICROS_PER_HOUR
from ..operators.features import HISTORY_ORDERS, fraud_score
from .buckets import bucket_of, pack, unpack

ORDERS = "order_id string, customer_id string, created_at timestamp, total_value double"
OUT = "order_id string, customer_id string, total_value double, risk double, velocity_24h long, avg_prev double"
STATE = {"customer_id": "string", "at_us": "int64", "cents": "int64"}
WINDOW_US = 24 * MICROS_PER_HOUR
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(old: list[tuple[int, int]], new: list[tuple[int, str, int]], window_us: int = WINDOW_US,
         history: int = HISTORY_ORDERS) -> tuple[list[tuple[int, float]], list[tuple[int, int]]]:
    """``(velocity, mean of the previous orders)`` of every new ``(time, id, cents)``, in their order, and what to keep.
    ``old`` holds ``(time, cents)`` in time order."""
    times = [t for t, _ in old]
    total = [0]
    for _, c in old:
        total.append(total[-1] + c)
    out = []
    for t, _, cents in new:
        n = len(times)
        velocity = bisect_left(times, t) - bisect_left(times, t - window_us)
        first = max(0, n - history)
        out.append((velocity, (total[n] - total[first]) / 100 / (n - first) if n > first else 0.0))
        times.append(t)
        total.append(total[-1] + cents)
    n = len(times)
    first = min(max(0, n - history), bisect_left(times, times[-1] - window_us)) if n else 0
    return out, [(times[i], total[i + 1] - total[i]) for i in range(first, n)]


class RecentOrders(StatefulProcessor):
    """Walks the customers of one bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "orders binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = defaultdict(list)
        for pdf in rows:
            cols = pdf[["customer_id", "at_us", "order_id", "cents", "total_value", "risk"]]
            for cid, t, oid, cents, value, risk in cols.itertuples(index=False, name=None):
                new[cid].append((int(t), oid, int(cents), value, risk))
        recent = defaultdict(list)
        if self.recent.exists():
            for cid, t, cents in unpack(self.recent.get()[0]):
                recent[cid].append((t, cents))
        scored = []
        for cid, own in new.items():
            own.sort(key=lambda r: r[:3])
            out, recent[cid] = walk(recent[cid], [r[:3] for r in own])
            scored += [(oid, cid, value, risk, *o) for (_, oid, _, value, risk), o in zip(own, out, strict=True)]
        self.recent.update((pack(STATE, ((cid, *o) for cid, kept in recent.items() for o in kept)),))
        yield pd.DataFrame(scored, columns=["order_id", "customer_id", "total_value", "risk", "velocity_24h", "avg_prev"])

    def close(self) -> None:
        pass


def fraud_features(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """``order_id, customer_id, velocity_24h, avg_prev, fraud_model_score`` of a stream ``orders(order_id, customer_id, created_at, total_value)``
    whose files come in time order; order ids are unique.  ``customers`` (static) gives the risk."""
    risk = customers.select("customer_id", F.col("risk_score").alias("risk"))
    o = orders.join(risk, "customer_id", "left").select(
        "order_id", "customer_id", F.unix_micros("created_at").alias("at_us"), F.coalesce("risk", F.lit(0.0)).alias("risk"),
        F.col("total_value").cast("double").alias("total_value"), (F.col("total_value").cast("decimal(20,2)") * 100).cast("long").alias("cents"))
    f = o.withColumn("bucket", bucket_of("customer_id")).groupBy("bucket").transformWithStateInPandas(RecentOrders(), OUT, "Append", "None")
    return f.select("order_id", "customer_id", "velocity_24h", "avg_prev",
                    fraud_score(F.col("velocity_24h"), F.col("total_value"), F.col("avg_prev"), F.col("risk")).alias("fraud_model_score"))


def run_fraud_stream(spark: SparkSession, source: str, customers: DataFrame, out: str, checkpoint: str, files_per_trigger: int = 1):
    """Score what is there and stop; the state lives in RocksDB."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        s = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        q = (fraud_features(s, customers).writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return q
