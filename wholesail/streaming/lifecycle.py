"""M8 / L10 streaming: customer lifecycle as per-customer state with event-time timers.

State per customer is two values (last activity time, status) — never the history.  On data,
a customer's new orders are walked in time order: thresholds crossed before each order are
emitted, and an order after inactivity emits ``CustomerReactivated``.  An event-time timer at
the next threshold (last + 60 / 150 / 330 days) emits the crossing once the watermark passes
it.  Churned is terminal.  Customers are grouped into buckets by hash (``buckets``): one call walks all customers of
a bucket, whose timer is the earliest of theirs.  The batch operator ``operators.lifecycle.lifecycle_transitions`` emits
the same events, plus crossings not yet closed by the stream's watermark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import MICROS_PER_DAY
from ..operators.lifecycle import CHURNED_DAYS, DORMANT_DAYS, INACTIVE_DAYS
from .buckets import bucket_of, pack, unpack

OUT_SCHEMA = ("customer_id string, event_type string, timestamp timestamp, days_without_order int, "
              "days_inactive int, channel string")
STATE_SCHEMA = "customers binary"
CUSTOMERS = {"customer_id": "string", "last_us": "int64", "status": "string"}
NEXT = {"active": ("CustomerBecameInactive", INACTIVE_DAYS, "inactive"),
        "inactive": ("CustomerBecameDormant", DORMANT_DAYS, "dormant"),
        "dormant": ("CustomerChurned", CHURNED_DAYS, "churned")}
D = MICROS_PER_DAY


def _row(cid, et, t_us, dwo, di, ch):
    return (cid, et, pd.Timestamp(t_us, unit="us"), dwo, di, ch)


def _passed(cid, last: int, status: str, until_us: int, out: list) -> str:
    """Emit the crossings before ``until_us``; returns the status after them."""
    while status in NEXT and last + NEXT[status][1] * D < until_us:
        et, days, nxt = NEXT[status]
        out.append(_row(cid, et, last + days * D, days, None, None))
        status = nxt
    return status


def _walk(cid, rows: list[tuple], last: int | None, status: str, out: list) -> tuple[int, str]:
    """A customer's new ``(time, channel, kind)`` in time order; returns its state after them."""
    for t, channel, kind in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if status == "churned":
            break
        if last is None:  # first anchor (creation or first order)
            last = t
            continue
        status = _passed(cid, last, status, t + 1, out)
        if status == "churned":
            break
        if status in ("inactive", "dormant") and kind == "order":
            out.append(_row(cid, "CustomerReactivated", t, None, int((t - last) // D), channel))
            status = "active"
        last = max(last, t)
    return last, status


def _lifecycle(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket: its customers' new rows, then every crossing of its customers that the watermark has passed."""
    out = []
    known = {cid: (last, status) for cid, last, status in unpack(state.get[0])} if state.exists else {}
    if not state.hasTimedOut:
        new = defaultdict(list)
        for p in pdfs:
            for cid, t, channel, kind in p[["customer_id", "t_us", "channel", "kind"]].itertuples(index=False, name=None):
                new[cid].append((int(t), channel, kind))
        for cid, rows in new.items():
            known[cid] = _walk(cid, rows, *known.get(cid, (None, "active")), out)
    wm_us = state.getCurrentWatermarkMs() * 1000
    known = {cid: (last, _passed(cid, last, status, wm_us, out)) for cid, (last, status) in known.items()}
    state.update((pack(CUSTOMERS, ((cid, *s) for cid, s in known.items())),))
    timers = [last + NEXT[status][1] * D for last, status in known.values() if status in NEXT]
    if timers:
        # event-time timer at the bucket's next threshold crossing (milliseconds)
        state.setTimeoutTimestamp(int(min(timers) // 1000))
    yield pd.DataFrame(out, columns=["customer_id", "event_type", "timestamp", "days_without_order",
                                     "days_inactive", "channel"])


def lifecycle_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """stream(customer_id, ts, channel, kind in {created, order}) → lifecycle events (append)."""
    s = stream.withWatermark("ts", watermark).select(
        "customer_id", "ts", F.unix_micros("ts").alias("t_us"), "channel", "kind", bucket_of("customer_id").alias("bucket"))
    return s.groupBy("bucket").applyInPandasWithState(
        _lifecycle, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_lifecycle_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str,
                         watermark: str = "1 day", files_per_trigger: int = 1):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = (lifecycle_stream(s, watermark).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
