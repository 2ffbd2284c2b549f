"""Registered queries: decisioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision as J
from .oracle import sql
from .q_projections import tables_of
from .registry import query

ENRICHED_COLS = [
    "order_id", "customer_id", "total_amount", "fraud_score", "customer_segment", "payment_method", "credit_limit",
    "customer_risk", "customer_type", "area_id", "rfm_r", "rfm_f", "rfm_m", "rfm_monetary", "avg_basket_90d",
]
# the seeded path stores numbers as decimals, where a zero fraud score reads as "missing" (T7)
SEEDED_ZERO_IS_MISSING = True
WHAT_IF_GRID = [(0.70, 0.40), (0.65, 0.40), (0.75, 0.45), (0.70, 0.35), (0.80, 0.50)]


def enriched(spark, d):
    return J.enrich_orders(tables_of(spark, d)["orders"], tables_of(spark, d)["customers"], tables_of(spark, d)["rfm_scores"])


def decided(spark, d):
    return J.route(J.score(enriched(spark, d), zero_is_missing=SEEDED_ZERO_IS_MISSING))


@query("order_enrichment", sql(f"SELECT {', '.join(ENRICHED_COLS)} FROM enriched", "enriched"), "J1 D6 B5 B8 T8 T9")
def q_enrichment(spark, d):
    return enriched(spark, d).select(*ENRICHED_COLS)


@query("order_scores", sql("""
SELECT order_id, ltv_score, fraud_approval_component, payment_score, decision_score, decision, model_version
FROM decided""", "decided"), "J2 J3 J4 J5 J6 B14 B15")
def q_scores(spark, d):
    return J.score(enriched(spark, d), zero_is_missing=SEEDED_ZERO_IS_MISSING).select(
        "order_id", "ltv_score", "fraud_approval_component", "payment_score", "decision_score", "decision",
        "model_version",
    )


@query("decision_audit", sql("SELECT * FROM audit_t", "audit_t"), "J7 J8 B16 B17")
def q_audit(spark, d):
    return J.audit(decided(spark, d))


@query("decision_distribution", sql("""
SELECT decision, count(*) AS count FROM decided GROUP BY decision""", "decided"), "J11 E11")
def q_decision_distribution(spark, d):
    return J.distribution(decided(spark, d), "decision")


@query("action_distribution", sql("""
SELECT action, priority, count(*) AS count FROM routed GROUP BY action, priority""", "routed"), "J11 E11")
def q_action_distribution(spark, d):
    return decided(spark, d).groupBy("action", "priority").agg(F.count(F.lit(1)).alias("count"))


def _what_if_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS a, {r}::DOUBLE AS r" for a, r in WHAT_IF_GRID)
    return sql(f"""
SELECT g.a AS approve_threshold, g.r AS review_threshold,
       count(*) FILTER (WHERE s.composite_raw >= g.a) AS approve,
       count(*) FILTER (WHERE s.composite_raw >= g.r AND s.composite_raw < g.a) AS review,
       count(*) FILTER (WHERE s.composite_raw < g.r) AS decline,
       count(*) FILTER (WHERE s.composite_raw >= g.a) / count(*) AS approve_share,
       count(*) FILTER (WHERE s.composite_raw >= g.r AND s.composite_raw < g.a) / count(*) AS review_share,
       count(*) FILTER (WHERE s.composite_raw < g.r) / count(*) AS decline_share
FROM scored s, ({rows}) g GROUP BY g.a, g.r""", "scored")


@query("threshold_what_if", _what_if_sql(), "J12")
def q_what_if(spark, d):
    scored = J.score(enriched(spark, d), zero_is_missing=SEEDED_ZERO_IS_MISSING)
    return J.threshold_what_if(scored, WHAT_IF_GRID)

