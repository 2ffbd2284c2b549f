"""Golden rows for scoring and routing (hand-computed from the decision rules)."""

import uuid

import pytest
from pyspark.sql import functions as F

from wholesail.functions.scalar import uuid5_dns
from wholesail.operators.decision import audit, route, score

SCHEMA = "customer_segment string, fraud_score string, payment_method string, total_amount string, avg_basket_90d string"
GOLDEN = [
    # segment, fraud, method, amount, avg, ltv, fraud comp, payment, composite, outcome
    ("premium", "0.0", "credit", "1000", None, 1.0, 1.0, 0.891, 0.97275, "AUTO_APPROVE"),
    ("churned", "0.95", "cash", "48000", None, 0.1, 0.05, 0.315, 0.13625, "DECLINE"),
    ("standard", "0.45", "cod", "20000", None, 0.6, 0.55, 0.40, 0.5325, "MANUAL_REVIEW"),
    ("premium", "0.0", "cash", "50000", "10000", 1.0, 1.0, 0.315, 0.82875, "AUTO_APPROVE"),
    ("premium", "0.0", "cash", "5000", "20000", 1.0, 1.0, 0.45, 0.8625, "AUTO_APPROVE"),
    ("vip_unknown", "1.5", "credit", "5000", None, 0.4, 0.0, 0.855, 0.37375, "DECLINE"),
]


def test_golden_scores(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], SCHEMA)
    rows = score(df).collect()
    for r, g in zip(rows, GOLDEN):
        assert r["composite_raw"] == pytest.approx(g[8], abs=1e-9)
        assert r["ltv_score"] == pytest.approx(g[5])
        assert r["fraud_approval_component"] == pytest.approx(g[6])
        assert r["payment_score"] == pytest.approx(g[7], abs=1e-4)
        assert r["decision"] == g[9]
        assert r["model_version"] == "v1.0"


def test_zero_fraud_is_missing_on_seeded_path(spark):
    df = spark.createDataFrame([("premium", 0.0, "credit", 1000.0, 0.0)],
                               "customer_segment string, fraud_score double, payment_method string, "
                               "total_amount double, avg_basket_90d double")
    assert score(df, zero_is_missing=True).first()["fraud_approval_component"] == pytest.approx(0.5)
    assert score(df, zero_is_missing=False).first()["fraud_approval_component"] == pytest.approx(1.0)


def test_defaults_for_missing_inputs(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    r = score(df).first()
    # standard tier, fraud 0.5, cod, no basket: 0.4·0.6 + 0.35·0.5 + 0.25·0.5
    assert r["composite_raw"] == pytest.approx(0.24 + 0.175 + 0.125)


@pytest.mark.parametrize("decision,score_,action,priority", [
    ("AUTO_APPROVE", 0.1, "FULFILLED", "normal"),
    ("MANUAL_REVIEW", 0.54, "ESCALATED", "high"),
    ("MANUAL_REVIEW", 0.55, "ESCALATED", "medium"),
    ("DECLINE", 0.9, "REJECTED", "normal"),
    ("UNKNOWN", 0.9, "REJECTED", "normal"),
])
def test_routing(spark, decision, score_, action, priority):
    df = spark.createDataFrame([(decision, score_)], "decision string, decision_score double")
    r = route(df).first()
    assert (r["action"], r["priority"]) == (action, priority)
    if decision == "MANUAL_REVIEW":
        assert r["action_detail"].endswith(f"score {score_:.3f}")


def test_uuid5_matches_python(spark):
    names = ["ORD-1", "ORD-42", "ORD-999999", "C-7"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(uuid5_dns(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_audit_row_defaults(spark):
    df = spark.createDataFrame([("ORD-1", "FULFILLED", "x", "normal", None, None, None, None, None, None)],
                               "order_id string, action string, action_detail string, priority string, "
                               "decision string, decision_score double, customer_id string, "
                               "customer_segment string, total_amount double, payment_method string")
    r = audit(df).first()
    assert r["action_id"] == "91a28441-55e1-5f4c-a8b7-7ca9c233b97d"
    assert (r["decision"], r["composite_score"], r["customer_id"], r["total_amount"]) == ("UNKNOWN", 0.0, "", 0.0)
