"""Ordered stages, conversion and survival on small hand-checked rows."""

import datetime as dt

import pytest

from wholesail.operators import funnel as FN


def at(n, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)


def frames(spark):
    entered = spark.createDataFrame([("a", at(0), "x"), ("a", at(3), "y"), ("b", at(0), "x"), ("c", at(1), "x"), ("d", at(2), "y"), (None, at(0), "x"), ("e", None, "x")],
                                    "customer_id string, timestamp timestamp, cohort string")
    e = lambda rows: spark.createDataFrame(rows, "customer_id string, timestamp timestamp")
    order = e([("a", at(-1)), ("a", at(4, 5)), ("a", at(9)), ("b", at(0)), ("d", at(1)), ("z", at(1))])
    paid = e([("a", at(4)), ("a", at(6)), ("c", at(5)), ("b", at(0))])
    return entered, {"order": order, "paid": paid}


def test_stages_are_matched_in_order(spark):
    t = FN.stage_times(*frames(spark))
    got = {r["customer_id"]: (r["cohort"], r["entered"], r["order"], r["paid"]) for r in t.collect()}
    assert got == {"a": ("x", at(0), at(4, 5), at(6)), "b": ("x", at(0), at(0), at(0)), "c": ("x", at(1), None, None), "d": ("y", at(2), None, None)}
    rows = {(r["cohort"], r["stage"]): (r["customers"], r["conversion"], r["median_days"]) for r in FN.conversion(t, ["order", "paid"]).collect()}
    assert rows == {("x", "entered"): (3, 1.0, 0), ("x", "order"): (2, pytest.approx(2 / 3), 0), ("x", "paid"): (2, 1.0, 0),
                    ("y", "entered"): (1, 1.0, 0), ("y", "order"): (0, 0.0, None), ("y", "paid"): (0, None, None)}


def test_survival_with_censored_customers(spark):
    rows = [("p", at(0), at(1))] + [(f"q{i}", at(0), at(3)) for i in range(2)] + [("r", at(0), None), ("s", at(8), None), ("t", at(0), at(20)), ("late", at(11), None)]
    t = spark.createDataFrame([(c, "x", e, o) for c, e, o in rows], "customer_id string, cohort string, entered timestamp, stage timestamp")
    now = spark.createDataFrame([(at(10),)], "now timestamp")
    got = sorted((r["day"], r["at_risk"], r["events"], round(r["survival"], 6)) for r in FN.survival(t, "stage", now).collect())
    assert got == [(1, 6, 1, round(5 / 6, 6)), (3, 4, 2, round(5 / 6 * 2 / 4, 6))]
    all_hit = t.filter("customer_id in ('p', 'q0')")
    assert [round(r["survival"], 6) for r in FN.survival(all_hit, "stage", now).orderBy("day").collect()] == [0.5, 0.0]
    assert FN.survival(t.limit(0), "stage", now).count() == 0
