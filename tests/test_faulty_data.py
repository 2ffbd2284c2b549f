"""The operators that look for faults, on tables that have some, and what the registered queries return."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from oracle_check import duck

import __spark_entry__ as E
from wholesail.operators import quality as H

T0 = dt.datetime(2024, 1, 1)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), ("c",), ("a",)], "id string")
    assert {r["id"]: r["copies"] for r in H.duplicate_keys(df, "id").collect()} == {"a": 3, None: 2}


def test_impossible_values(spark):
    orders = spark.createDataFrame([(-0.1,), (0.0,), (None,)], "fraud_score double")
    payments = spark.createDataFrame([(0, 5.0), (-1, -5.0), (1, None), (None, 2.0)], "attempt_number int, amount double")
    invoices = spark.createDataFrame([(-30,), (0,), (30,)], "terms_days int")
    stock = spark.createDataFrame([(-1,), (-2,), (0,)], "estimated_on_hand long")
    got = {r["field"]: r["violations"] for r in H.impossible_values(orders, payments, invoices, stock).collect()}
    assert got == {"fraud_score<0": 1, "attempt_number<=0": 2, "terms_days<0": 1, "stock<0": 2, "amount<0": 1}


def test_paid_before_invoiced(spark):
    inv = spark.createDataFrame([("i1", T0), ("i2", T0), ("i3", T0)], "invoice_id string, timestamp timestamp")
    pay = spark.createDataFrame(
        [("i1", "paid", T0 - dt.timedelta(seconds=1)), ("i2", "paid", T0), ("i3", "failed", T0 - dt.timedelta(days=1))],
        "invoice_id string, status string, timestamp timestamp")
    assert H.paid_before_invoiced(inv, pay).first()[0] == 1


def test_unstable_dimension(spark):
    df = spark.createDataFrame([("s1", "A"), ("s1", "B"), ("s1", "A"), ("s2", "C"), ("s2", None)], "sku string, cls string")
    assert [tuple(r) for r in H.unstable_dimension(df, "sku", "cls").collect()] == [("s1", 2)]


def test_rules_see_each_violation(spark):
    ledger = spark.createDataFrame([("c", "debit", 60.0, 60.0, 60.0), ("c", "debit", 120.0, 60.0, 60.0), ("x", "debit", 1.0, 1.0, 1.0)],
                                   "customer_id string, transaction_type string, running_balance double, signed_amount double, amount double")
    customers = spark.createDataFrame([("c", 100.0)], "customer_id string, credit_limit double")
    history = spark.createDataFrame([("c", "CustomerChurned", T0)], "customer_id string, event_type string, timestamp timestamp")
    orders = spark.createDataFrame([("c", T0 + dt.timedelta(days=1)), ("c", T0 - dt.timedelta(days=1))], "customer_id string, created_at timestamp")
    stockouts = spark.createDataFrame([(5, 6), (6, 6)], "available_quantity long, requested_quantity long")
    payments = spark.createDataFrame([("i", "paid", 60.0), ("i", "paid", 60.0)], "invoice_id string, status string, amount double")
    invoices = spark.createDataFrame([("i", 100.0)], "invoice_id string, amount double")
    promises = spark.createDataFrame([("2024-01-01", T0), ("2023-12-31", T0), (None, T0)], "promise_date string, timestamp timestamp")
    out = H.business_rule_violations(ledger, customers, history, orders, stockouts, payments, invoices, promises)
    assert {r["rule_id"]: (r["checked"], r["violations"]) for r in out.collect()} == {
        "CR-01": (3, 2), "CR-02": (2, 1), "INV-01": (2, 1), "PAY-01": (1, 1), "COLL-01": (3, 2)}


def test_champions(spark):
    from wholesail.operators.cookbook import rfm_champions

    rows = [("a", "2024-02", "5", "4", "4", 9.0, 3), ("b", "2024-02", "5", "3", "5", 8.0, 1), ("c", "2024-01", "5", "5", "5", 7.0, 2), ("d", "2024-02", "4", "5", "5", 1.0, 0), ("gone", "2024-02", "5", "5", "5", 2.0, 1)]
    rfm = spark.createDataFrame(rows, "customer_id string, month string, r_score string, f_score string, m_score string, monetary double, recency_days int")
    customers = spark.createDataFrame([(i, i.upper(), "premium", "X", "kiosk") for i in "abcd"], "customer_id string, name string, segment string, area_id string, customer_type string")
    assert sorted((r["customer_id"], r["r"], r["f"], r["m"], r["trailing_gmv"]) for r in rfm_champions(rfm, customers).collect()) == [("a", 5, 4, 4, 9.0), ("d", 4, 5, 5, 1.0)]


#: Queries that look for faults the derived log does not have: no rows, or only zeros.
NO_FAULTS = {"duplicate_event_ids", "duplicate_order_ids", "unstable_sku_class", "rfm_champions"}
#: Result columns that hold one value by definition or by the derivation's rules.
ONE_VALUE = {
    ("customers", "created_at"), ("invoices", "terms_days"), ("order_scores", "model_version"), ("customer_type_mix", "count"),
    ("impossible_values", "violations"), ("fraud_velocity_windows", "action"), ("session_funnel", "searches"), ("inventory_policy", "reorder"),
    ("supplier_lead_times", "purchase_orders"), ("best_promotion", "rejected"), ("dunning", "write_off_due"),
    ("causal_chains", "cyclic"), ("fraud_alerts", "fraud_type"),  # cycles: tests/test_graphs.py; no score of 0.8 without velocity
    ("record_picker", "customer_segment"), ("record_picker", "payment_method"), ("smoke_assertions", "ok"),
}


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith("op") or n.startswith("order")))
def test_results_vary(name):
    d = duck(SF_SMALL).execute(E.oracle_sql()[name]).fetchdf()
    assert len(d) or name in NO_FAULTS
    same = {c for c in d.columns if len(d) > 1 and d[c].astype(str).nunique(dropna=False) == 1}
    assert {(name, c) for c in same} <= ONE_VALUE


def test_fraud_alerts(spark):
    from wholesail.operators.features import fraud_alerts

    rows = [("o1", "c1", 5, 0.95), ("o2", "c1", 0, 0.85), ("o3", "c2", 9, 0.79), ("o4", "c2", 3, None)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, velocity_24h long, fraud_model_score double")
    assert sorted(map(tuple, fraud_alerts(df).collect())) == [
        ("o1", "c1", 0.95, "rejected", "velocity"), ("o2", "c1", 0.85, "flagged", "amount_spike")]


def test_to_envelope(spark):
    from wholesail.sources.eventlog import ENVELOPE_COLS, to_envelope

    df = spark.createDataFrame([("e1", "a1", T0, 5, None)], "id string, agg string, ts timestamp, quantity int, note string")
    out = to_envelope(df, "StockReceived", "id", "agg", "ts")
    assert out.columns == ENVELOPE_COLS
    r = out.first()
    assert (r["event_id"], r["event_type"], r["aggregate_id"], r["timestamp"], r["payload"]) == ("e1", "StockReceived", "a1", T0, '{"quantity":5}')
