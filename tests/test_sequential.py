"""Path-dependent scans against a brute-force replay, with keys split across Arrow batches."""

import datetime as dt

import pytest

from wholesail.operators.credit import credit_check
from wholesail.operators.inventory import allocate


def ts(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_credit_golden(spark):
    orders = spark.createDataFrame([("o1", "c", ts(1), 60.0), ("o2", "c", ts(2), 50.0), ("o3", "c", ts(3), 30.0)],
                                   "order_id string, customer_id string, created_at timestamp, total_value double")
    rel = spark.createDataFrame([], "order_id string, customer_id string, timestamp timestamp")
    cust = spark.createDataFrame([("c", 100.0)], "customer_id string, credit_limit double")
    out = credit_check(orders, rel, cust).orderBy("ts").collect()
    assert [r["accepted"] for r in out] == [True, False, True]
    assert out[-1]["used_after"] == pytest.approx(90.0)


def brute_credit(orders, releases, limits):
    ev = sorted([(c, t, 1, o, a) for o, c, t, a in orders] + [(c, t, 0, o, None) for o, c, t in releases])
    used, open_, res = {}, {}, {}
    for c, t, k, o, a in ev:
        u = used.get(c, 0.0)
        if k == 1:
            ok = u + a <= limits.get(c, 0.0)
            if ok:
                u += a
                open_[(c, o)] = a
            res[o] = (ok, u)
        elif (c, o) in open_:
            u = max(0.0, u - open_.pop((c, o)))
        used[c] = u
    return res


@pytest.mark.parametrize("batch", [2, 10000])
def test_credit_brute_force(spark, batch):
    import random

    rnd = random.Random(3)
    orders, releases = [], []
    for i in range(300):
        c = "hot" if i % 2 else f"c{i % 7}"
        orders.append((f"o{i}", c, ts(i), float(rnd.randint(10, 90))))
        if rnd.random() < 0.5:
            releases.append((f"o{i}", c, ts(i + rnd.randint(1, 30))))
    limits = {"hot": 300.0, **{f"c{j}": 150.0 for j in range(7)}}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        o = spark.createDataFrame(orders, "order_id string, customer_id string, created_at timestamp, total_value double")
        r = spark.createDataFrame(releases, "order_id string, customer_id string, timestamp timestamp")
        cu = spark.createDataFrame(list(limits.items()), "customer_id string, credit_limit double")
        got = {x["order_id"]: (x["accepted"], x["used_after"]) for x in
               credit_check(o, r, cu).filter("kind = 'order'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_credit(orders, releases, limits)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1])


def test_allocation_later_smaller_lines_fit(spark):
    rec = spark.createDataFrame([("s", ts(0), "po", 10)], "sku_id string, timestamp timestamp, ref string, quantity long")
    dem = spark.createDataFrame([("s", ts(1), "a", 6), ("s", ts(2), "b", 6), ("s", ts(3), "c", 4)],
                                "sku_id string, timestamp timestamp, ref string, quantity long")
    out = allocate(rec, dem).filter("kind = 'demand'").orderBy("timestamp").collect()
    assert [(r["reserved"], r["available_before"]) for r in out] == [(True, 10), (False, 4), (True, 4)]
