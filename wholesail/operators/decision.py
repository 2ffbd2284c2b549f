"""Explainable order decisioning as column functions.

The same functions score a batch DataFrame and a streaming one (``streaming.decisions``):
enrichment is joins, scoring/routing are ``when`` chains and literal maps — no UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import map_values, uuid5_dns
from .joins import dim_join

# ---------------------------------------------------------------------------
# Fixed values of the scoring model (decision function constants)
# ---------------------------------------------------------------------------
LTV_SCORES = {"premium": 1.00, "standard": 0.60, "at-risk": 0.20, "new": 0.40, "churned": 0.10}
LTV_DEFAULT = 0.40
METHOD_RISK = {
    "credit": 0.90, "bank_transfer": 0.80, "direct_debit": 0.80, "cheque": 0.65, "cod": 0.50, "cash": 0.45,
}
METHOD_DEFAULT = 0.50
BASKET_NORMALISER = 30_000.0
APPROVE_THRESHOLD, REVIEW_THRESHOLD = 0.70, 0.40
WEIGHTS = {"ltv": 0.40, "fraud": 0.35, "payment": 0.25}
MAX_PENALTY, DEVIATION_SPAN = 0.30, 4.0
ESCALATE_HIGH_BELOW = 0.55
MODEL_VERSION = "v1.0"
# customer segment → LTV tier label used by the scorer (unmapped → standard)
SEGMENT_MAP = {"premium": "premium", "regular": "standard", "low_volume": "at-risk"}
DETAIL_APPROVED = "Order approved and routed to fulfillment DC"
DETAIL_ESCALATED = "Order escalated to review queue — score "
DETAIL_DECLINED = "Order declined — insufficient approval score; credit team notified"


def _num_map(mapping: dict[str, float], key: Column, default: float) -> Column:
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
    return F.coalesce(m[key], F.lit(default))


def round_dp(x: Column, dp: int) -> Column:
    """Round half up in binary (``floor(x·10^dp + 0.5) / 10^dp``): identical in every engine."""
    s = float(10**dp)
    return F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s)


def fixed3(x: Column) -> Column:
    """Three-decimal text of a non-negative score from integer thousandths (T17: no float formatting)."""
    m = F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("long")
    whole = F.call_function("div", m, F.lit(1000))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))


def fraud_input(fraud: Column, zero_is_missing: bool = False) -> Column:
    """Missing → 0.5; with ``zero_is_missing`` a numeric 0 is also treated as missing."""
    f = fraud.cast("double")
    if zero_is_missing:
        return F.when(f.isNull() | (f == 0), F.lit(0.5)).otherwise(f)
    return F.coalesce(f, F.lit(0.5))


def score(
    df: DataFrame,
    zero_is_missing: bool = False,
    approve: float = APPROVE_THRESHOLD,
    review: float = REVIEW_THRESHOLD,
) -> DataFrame:
    """LTV, fraud and payment factors, composite, outcome and 4-dp lineage columns.

    Input columns: customer_segment, fraud_score, payment_method, total_amount, avg_basket_90d.
    """
    seg = F.lower(F.coalesce(F.col("customer_segment").cast("string"), F.lit("standard")))
    ltv = _num_map(LTV_SCORES, seg, LTV_DEFAULT)
    raw = fraud_input(F.col("fraud_score"), zero_is_missing)
    fraud = F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    method = F.lower(F.coalesce(F.col("payment_method").cast("string"), F.lit("cod")))
    m_score = _num_map(METHOD_RISK, method, METHOD_DEFAULT)
    basket = F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0))
    avg = F.coalesce(F.col("avg_basket_90d").cast("double"), F.lit(0.0))
    relative = F.least(F.greatest(basket / avg - F.lit(1.0), F.lit(0.0)) / F.lit(DEVIATION_SPAN), F.lit(1.0))
    absolute = F.least(basket / F.lit(BASKET_NORMALISER), F.lit(1.0))
    penalty = F.when(avg > 0, relative).otherwise(absolute) * F.lit(MAX_PENALTY)
    payment = m_score * (F.lit(1.0) - penalty)
    composite = F.lit(WEIGHTS["ltv"]) * ltv + F.lit(WEIGHTS["fraud"]) * fraud + F.lit(WEIGHTS["payment"]) * payment
    out = df.withColumn("_ltv", ltv).withColumn("_fraud", fraud).withColumn("_pay", payment).withColumn(
        "composite_raw", composite
    )
    c = F.col("composite_raw")
    return (
        out.withColumn(
            "decision",
            F.when(c >= approve, "AUTO_APPROVE").when(c >= review, "MANUAL_REVIEW").otherwise("DECLINE"),
        )
        .withColumn("ltv_score", round_dp(F.col("_ltv"), 4))
        .withColumn("fraud_approval_component", round_dp(F.col("_fraud"), 4))
        .withColumn("payment_score", round_dp(F.col("_pay"), 4))
        .withColumn("decision_score", round_dp(c, 4))
        .withColumn("model_version", F.lit(MODEL_VERSION))
        .drop("_ltv", "_fraud", "_pay")
    )


def route(df: DataFrame, decision: str = "decision", score_col: str = "decision_score") -> DataFrame:
    """FULFILLED / ESCALATED (high below .55, else medium) / REJECTED — on the stored 4-dp score."""
    d, s = F.col(decision), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    action = F.when(d == "AUTO_APPROVE", "FULFILLED").when(d == "MANUAL_REVIEW", "ESCALATED").otherwise("REJECTED")
    detail = (
        F.when(d == "AUTO_APPROVE", F.lit(DETAIL_APPROVED))
        .when(d == "MANUAL_REVIEW", F.concat(F.lit(DETAIL_ESCALATED), fixed3(s)))
        .otherwise(F.lit(DETAIL_DECLINED))
    )
    priority = F.when((d == "MANUAL_REVIEW") & (s < ESCALATE_HIGH_BELOW), "high").when(
        d == "MANUAL_REVIEW", "medium").otherwise("normal")
    return df.withColumn("action", action).withColumn("action_detail", detail).withColumn("priority", priority)


def audit(df: DataFrame, actioned_at: Column | None = None) -> DataFrame:
    """One action-log row per order; id = UUIDv5(order_id) so replays overwrite nothing."""
    cols = [
        uuid5_dns(F.col("order_id")).alias("action_id"),
        F.col("order_id"),
        F.col("action"),
        F.col("action_detail"),
        F.col("priority"),
        F.coalesce(F.col("decision"), F.lit("UNKNOWN")).alias("decision"),
        F.coalesce(F.col("decision_score").cast("double"), F.lit(0.0)).alias("composite_score"),
        F.coalesce(F.col("customer_id"), F.lit("")).alias("customer_id"),
        F.coalesce(F.col("customer_segment"), F.lit("")).alias("customer_segment"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.col("payment_method"), F.lit("")).alias("payment_method"),
    ]
    if actioned_at is not None:
        cols.append(actioned_at.alias("actioned_at"))
    return df.select(*cols)


def latest_rfm(rfm: DataFrame) -> DataFrame:
    """The most recent RFM row per customer (``max_by`` month, not file order)."""
    return rfm.groupBy("customer_id").agg(
        F.max_by(F.struct("r_score", "f_score", "m_score", "monetary"), F.col("month")).alias("r")
    ).select("customer_id", F.col("r.r_score").alias("rfm_r"), F.col("r.f_score").alias("rfm_f"),
             F.col("r.m_score").alias("rfm_m"), F.col("r.monetary").alias("rfm_monetary"))


def enrich_orders(orders: DataFrame, customers: DataFrame, rfm: DataFrame, basket_baseline: DataFrame | None = None) -> DataFrame:
    """J1 (D6, B5, B8): orders + customer and RFM context with the seed's defaults.

    ``avg_basket_90d`` is the RFM ``monetary`` of the latest month (T8, as seeded); pass
    ``basket_baseline`` (order_id, avg_basket_90d) to use a true trailing mean instead (L2).
    Dimension joins are ``dim_join``: broadcast only under a checked size, else shuffle.
    """
    o = orders.filter(F.col("order_id").isNotNull() & F.col("customer_id").isNotNull())
    c = customers.select(
        "customer_id",
        map_values(F.coalesce(F.col("segment"), F.lit("regular")), SEGMENT_MAP, "standard").alias("_segment"),
        F.col("payment_method").alias("_method"),
        F.col("credit_limit").alias("_limit"),
        F.col("risk_score").alias("_risk"),
        F.col("customer_type").alias("_ctype"),
        F.col("area_id").alias("_area"),
    )
    r = latest_rfm(rfm)
    j = dim_join(o, c, "customer_id")
    j = dim_join(j, r, "customer_id")
    out = j.select(
        "order_id", "customer_id", "created_at", "status", "channel", "rep_id",
        F.coalesce(F.col("total_value").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.col("fraud_score").cast("double"), F.lit(0.5)).alias("fraud_score"),
        F.coalesce("_segment", F.lit("standard")).alias("customer_segment"),
        F.coalesce("_method", F.lit("cash")).alias("payment_method"),
        F.coalesce("_limit", F.lit(0.0)).alias("credit_limit"),
        F.coalesce("_risk", F.lit(0.0)).alias("customer_risk"),
        F.coalesce("_ctype", F.lit("")).alias("customer_type"),
        F.coalesce("_area", F.lit("")).alias("area_id"),
        F.coalesce("rfm_r", F.lit("")).alias("rfm_r"),
        F.coalesce("rfm_f", F.lit("")).alias("rfm_f"),
        F.coalesce("rfm_m", F.lit("")).alias("rfm_m"),
        F.coalesce("rfm_monetary", F.lit(0.0)).alias("rfm_monetary"),
        F.coalesce("rfm_monetary", F.lit(0.0)).alias("avg_basket_90d"),
    )
    if basket_baseline is not None:
        out = out.drop("avg_basket_90d").join(basket_baseline, "order_id", "left").withColumn(
            "avg_basket_90d", F.coalesce("avg_basket_90d", F.lit(0.0))
        )
    return out


def distribution(df: DataFrame, col: str) -> DataFrame:
    """``stats count(*) by col`` sorted by count."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def threshold_what_if(scored: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Outcome split for several (approve, review) threshold pairs in ONE pass.

    Each pair becomes three conditional counts of a single aggregate (no cross join with the
    grid); the wide row is unpivoted with ``stack``.
    """
    c = F.col("composite_raw")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (a, r) in enumerate(grid):
        aggs += [
            F.count_if(c >= a).alias(f"a{i}"),
            F.count_if((c >= r) & (c < a)).alias(f"r{i}"),
            F.count_if(c < r).alias(f"d{i}"),
        ]
    wide = scored.agg(*aggs)
    parts = ", ".join(f"{a}D, {r}D, a{i}, r{i}, d{i}" for i, (a, r) in enumerate(grid))
    long = wide.selectExpr("n", f"stack({len(grid)}, {parts}) AS (approve_threshold, review_threshold, approve, review, decline)")
    return long.select(
        "approve_threshold", "review_threshold", "approve", "review", "decline",
        (F.col("approve") / F.col("n")).alias("approve_share"),
        (F.col("review") / F.col("n")).alias("review_share"),
        (F.col("decline") / F.col("n")).alias("decline_share"),
    )
