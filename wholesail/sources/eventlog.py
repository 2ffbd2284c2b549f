"""The append-only event log.

The log is one table with a fixed envelope and a JSON payload.  On disk it is
parquet partitioned by ``event_type`` so a read of one type prunes every other
partition (see ``logstore``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files, keyed

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("aggregate_id", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("payload", T.StringType(), True),
        T.StructField("causation_id", T.StringType(), True),
        T.StructField("correlation_id", T.StringType(), True),
    ]
)
ENVELOPE_COLS = [f.name for f in ENVELOPE.fields]
#: An event without its payload.
ENVELOPES = [c for c in ENVELOPE_COLS if c != "payload"]


def _s(*names: str, **typed: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in names]
    fields += [T.StructField(n, t) for n, t in typed.items()]
    return T.StructType(fields)


D, L, I, B = T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

ORDER_LINE = T.StructType(
    [
        T.StructField("sku_id", T.StringType()),
        T.StructField("quantity", L),
        T.StructField("unit_price", D),
        T.StructField("line_total", D),
        T.StructField("demand_class", T.StringType()),
        T.StructField("promotion_applied", B),
        T.StructField("discount_amount", D),
    ]
)

# Fixed values (typed-event registry): event_type -> payload schema, envelope fields excluded
REGISTRY: dict[str, T.StructType] = {
    "CustomerCreated": T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("credit_limit", D),
            T.StructField("acquisition_channel", T.StringType()),
            T.StructField("rep_id", T.StringType()),
            T.StructField("digital_active", B),
            T.StructField("customer_type", T.StringType()),
            T.StructField("area_id", T.StringType()),
            T.StructField("payment_method", T.StringType()),
            T.StructField("risk_score", D),
            T.StructField("name", T.StringType()),
            T.StructField("phone", T.StringType()),
        ]
    ),
    "CustomerBecameInactive": _s(days_without_order=I),
    "CustomerBecameDormant": _s(days_without_order=I),
    "CustomerChurned": _s(days_without_order=I),
    "CustomerReactivated": _s("channel", days_inactive=I),
    "CustomerSegmentChanged": _s("old_segment", "new_segment"),
    "OrderCreated": T.StructType(
        [
            T.StructField("customer_id", T.StringType()),
            T.StructField("order_id", T.StringType()),
            T.StructField("total_value", D),
            T.StructField("lines", T.ArrayType(ORDER_LINE)),
            T.StructField("channel", T.StringType()),
            T.StructField("rep_id", T.StringType()),
            T.StructField("promotion_id", T.StringType()),
            T.StructField("fraud_score", D),
        ]
    ),
    "OrderShipped": _s("order_id", "customer_id"),
    "OrderDelivered": _s("order_id", "customer_id"),
    "OrderCancelled": _s("order_id", "customer_id", "reason"),
    "OrderReturned": _s("order_id", "customer_id", "reason", return_value=D),
    "OrderRejected": _s("customer_id", "reason", attempted_value=D),
    "InvoiceCreated": _s("invoice_id", "order_id", "customer_id", "due_date", amount=D, terms_days=I),
    "PaymentCaptured": _s("invoice_id", "customer_id", "payment_method", amount=D, attempt_number=I),
    "PaymentFailed": _s("invoice_id", "customer_id", "reason", amount=D, attempt_number=I),
    "CreditWrittenOff": _s("customer_id", "invoice_id", amount=D, days_overdue=I),
    "CollectionScheduled": _s("invoice_id", "customer_id", days_overdue=I, amount_due=D),
    "CollectionPromiseMade": _s("invoice_id", "customer_id", "promise_date", promised_amount=D),
    "PurchaseOrderCreated": _s("purchase_order_id", "sku_id", "supplier_id", quantity=L, expected_lead_time_days=I),
    "StockReceived": _s("sku_id", "supplier_id", "purchase_order_id", quantity=L),
    "StockReserved": _s("sku_id", "order_id", quantity=L),
    "StockReleased": _s("sku_id", "order_id", "reason", quantity=L),
    "StockoutOccurred": _s("sku_id", "order_id", "resolution", requested_quantity=L, available_quantity=L),
    "PromotionApplied": _s("promotion_id", "order_id", "customer_id", discount_amount=D, original_value=D),
    "RepVisitCompleted": _s("rep_id", "customer_id", "outcome"),
    "AppSessionEvent": _s(
        "customer_id", "session_id", "event_subtype", "screen_name", "search_query",
        session_duration_seconds=I, led_to_order=B,
    ),
}

#: An OrderCreated event whose fields are still columns: the largest events, most of whose readers take few of the fields.
DECODED = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("OrderCreated", REGISTRY["OrderCreated"]),
    ]
)

#: Those of its fields that do not come from its lines.
HEAD_FIELDS = ["customer_id", "order_id", "total_value", "channel", "rep_id", "fraud_score"]

LIFECYCLE_TYPES = [
    "CustomerCreated",
    "CustomerBecameInactive",
    "CustomerBecameDormant",
    "CustomerChurned",
    "CustomerReactivated",
]
ORDER_STATUS_TYPES = ["OrderShipped", "OrderDelivered", "OrderCancelled", "OrderReturned"]


def envelope(
    event_type: str | Column,
    event_id: Column,
    aggregate_id: Column,
    ts: Column,
    payload: dict[str, Column],
    causation_id: Column | None = None,
    correlation_id: Column | None = None,
) -> list[Column]:
    """A4: the 7 envelope columns, with every non-envelope field folded into one JSON payload."""
    et = F.lit(event_type) if isinstance(event_type, str) else event_type
    body = F.to_json(F.struct(*[c.alias(k) for k, c in payload.items()]))
    return [
        event_id.cast("string").alias("event_id"),
        et.alias("event_type"),
        aggregate_id.cast("string").alias("aggregate_id"),
        ts.cast("timestamp").alias("timestamp"),
        body.alias("payload"),
        (causation_id if causation_id is not None else F.lit(None)).cast("string").alias("causation_id"),
        (correlation_id if correlation_id is not None else F.lit(None)).cast("string").alias("correlation_id"),
    ]


def order_envelope(payload: bool = True) -> list[Column]:
    """The envelope of ``DECODED`` rows, or all of it but the payload."""
    names = REGISTRY["OrderCreated"].fieldNames() if payload else HEAD_FIELDS
    cols = envelope("OrderCreated", F.col("event_id"), F.col("aggregate_id"), F.col("timestamp"),
                    {f: F.col("OrderCreated")[f] for f in names}, correlation_id=F.col("correlation_id"))
    return [c for n, c in zip(ENVELOPE_COLS, cols, strict=True) if payload or n != "payload"]


def to_envelope(df: DataFrame, event_type: str, id_col: str, aggregate_col: str, ts_col: str) -> DataFrame:
    """A4 on a typed frame: keep the envelope, move the rest into ``payload``."""
    skip = {id_col, aggregate_col, ts_col, "event_type"}
    payload = {c: F.col(c) for c in df.columns if c not in skip}
    return df.select(*envelope(event_type, F.col(id_col), F.col(aggregate_col), F.col(ts_col), payload))


def read_events(log: DataFrame, *event_types: str) -> DataFrame:
    """A1/A2: one or several event types (partition-pruned on a partitioned log)."""
    if len(event_types) == 1:
        return log.filter(F.col("event_type") == event_types[0])
    return log.filter(F.col("event_type").isin(list(event_types)))


def typed(log: DataFrame, event_type: str, fields: list[str] | None = None, strict: bool = False) -> DataFrame:
    """B1/B2: envelope + the payload decoded once with the registry schema (absent fields → null).

    A payload that does not fit (broken JSON, text where a number belongs) gives nulls; with ``strict`` (B7) it fails the
    job.  ``malformed_events`` finds them.  Where the log has the fields as a column named as the type (``stored_log`` with
    ``decoded``), they are taken from it: the payload is its text."""
    schema = REGISTRY[event_type]
    if fields is not None:
        schema = T.StructType([schema[f] for f in fields])
    own = read_events(log, event_type)
    if event_type in log.columns:
        return own.select(*ENVELOPE_COLS, *[F.col(event_type)[f].alias(f) for f in schema.fieldNames()])
    p = F.from_json(F.col("payload"), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return own.select(
        *[c for c in ENVELOPE_COLS if c != "payload"], "payload", p.alias("_p")
    ).select(*ENVELOPE_COLS, "_p.*")


def malformed_events(log: DataFrame, *event_types: str) -> DataFrame:
    """The events whose payload does not fit the registry schema of their type; a null payload does not.  All registered
    types if none is named."""
    out = None
    for t in event_types or REGISTRY:
        schema = T.StructType([*REGISTRY[t].fields, T.StructField("_bad", T.StringType())])
        p = F.from_json(F.col("payload"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        own = read_events(log, t).withColumn("_p", p)
        own = own.filter(F.col("payload").isNull() | F.col("_p").isNull() | F.col("_p._bad").isNotNull()).select(*ENVELOPE_COLS)
        out = own if out is None else out.unionByName(own)
    return out


def event_count(log: DataFrame) -> DataFrame:
    """A5: total rows as a one-row frame."""
    return log.agg(F.count(F.lit(1)).alias("events"))


def append_events(spark: SparkSession, new: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """A3: insert-or-ignore on ``event_id`` — first write wins, within the batch and against the log; rows without an id stay.

    The ids of the log lie beside it in a keyed folder, so that only files that may hold one of the new ids are looked
    at.  The batch is de-duplicated by id, the ids that other batches have written are dropped, and the rest becomes the
    partitions ``event_type=../batch=..``.  A batch repeated under its name replaces itself.  Returns the rows written."""
    path = path.rstrip("/")
    name = batch or uuid.uuid4().hex
    ids_path = f"{path}/_ids"
    if files.has_data(spark, path) and not files.exists(spark, ids_path):  # a log that was not written here
        keyed.claim(spark, spark.read.schema(ENVELOPE).parquet(path).filter("event_id is not null").select("event_id").distinct(), ids_path, "event_id", "before")
    with keyed.scratch(spark) as s:
        rows = s.keep(new.select(*ENVELOPE_COLS))
        first = F.min_by(F.struct(*ENVELOPE_COLS), F.struct("timestamp", "event_type", "aggregate_id", "payload"))
        named = rows.filter("event_id is not null").groupBy("event_id").agg(first.alias("_e")).select("_e.*")
        mine = keyed.claim(spark, named.select("event_id"), ids_path, "event_id", name)
        kept = named.join(mine, "event_id", "left_semi").select(*ENVELOPE_COLS).unionByName(rows.filter("event_id is null"))
        out = kept.withColumn("batch", F.lit(f"b-{name}"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type", "batch").parquet(path)
    schema = T.StructType([*ENVELOPE.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") == f"b-{name}").select(*ENVELOPE_COLS)


def type_registry_report(log: DataFrame) -> DataFrame:
    """Events per type, flagging types the registry does not know."""
    spark = log.sparkSession
    known = spark.createDataFrame([(t,) for t in REGISTRY], "event_type string").withColumn("registered", F.lit(True))
    return (
        log.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .join(F.broadcast(known), "event_type", "left")
        .select("event_type", "events", F.coalesce("registered", F.lit(False)).alias("registered"))
    )
