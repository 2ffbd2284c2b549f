"""Rules with conditions on several scopes against a plain check of every rule."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wholesail.operators.promotions import best_fitting


def test_best_fitting_equals_a_plain_check(spark):
    rng = random.Random(3)
    orders = [(f"o{i}", dt.datetime(2024, 1, rng.randint(1, 28)), float(rng.randint(1, 400)), rng.choice(["p", "r", None]), rng.choice(["app", "rep"])) for i in range(300)]
    rules = [(f"r{i}", rng.choice(["percentage", "fixed", "bogo"]), float(rng.randint(0, 90)), dt.date(2024, 1, a := rng.randint(1, 20)), dt.date(2024, 1, a + rng.randint(0, 8))) for i in range(14)]
    conditions = [(f"r{i}", s, v) for i in range(12) for s, v in [("seg", "p"), ("seg", "r"), ("ch", "app"), ("ch", None)] if rng.random() < 0.4]
    conditions += [("r0", "ch", "app"), ("r0", "ch", "app")]
    o = spark.createDataFrame(orders, "order_id string, created_at timestamp, total_value double, seg string, ch string")
    r = spark.createDataFrame(rules, "promotion_id string, promotion_type string, value double, start_day date, end_day date")
    c = spark.createDataFrame(conditions, "promotion_id string, scope string, scope_value string")
    got = sorted(tuple(x) for x in best_fitting(o, {"seg": F.col("seg"), "ch": F.col("ch")}, r, c).collect())
    want = []
    for oid, at, total, seg, ch in orders:
        fits, best = 0, None
        for pid, kind, value, lo, hi in rules:
            named = {s for p, s, _ in conditions if p == pid}
            ok = all({"seg": seg, "ch": ch}[s] in {v for p, t, v in conditions if p == pid and t == s and v is not None} for s in named)
            if ok and lo <= at.date() <= hi:
                fits += 1
                left = max(0.0, total * (1 - value / 100)) if kind == "percentage" else max(0.0, total - value) if kind == "fixed" else total * 0.5
                if total - left > 0 and (best is None or (-(total - left), pid) < (-best[2], best[0])):
                    best = (pid, kind, total - left)
        off = best[2] if best else 0.0
        want.append((oid, fits, best[0] if best else None, best[1] if best else None, off, total - off, total - off <= 0))
    assert got == sorted(want)
    assert any(x[1] == 0 for x in want) and any(x[6] for x in want) and len({x[3] for x in want}) == 4


def test_no_rules(spark):
    o = spark.createDataFrame([("o", dt.datetime(2024, 1, 1), 5.0, "x")], "order_id string, created_at timestamp, total_value double, seg string")
    r = spark.createDataFrame([], "promotion_id string, promotion_type string, value double, start_day date, end_day date")
    c = spark.createDataFrame([], "promotion_id string, scope string, scope_value string")
    assert [tuple(x) for x in best_fitting(o, {"seg": F.col("seg")}, r, c).collect()] == [("o", 0, None, None, 0.0, 5.0, False)]
