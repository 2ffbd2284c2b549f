"""Bounded walks cut into chunks against a plain loop, and the event log of a hot key."""

import datetime as dt
import random

import pytest

from wholesail.operators.credit import credit_check
from wholesail.operators.inventory import allocate
from wholesail.operators.sequential import bounded_walk


def ts(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


ROWS = "key string, ts timestamp, n long, take boolean, amount long, tie string"


def plain(rows, rooms):
    out, state = [], {}
    for key, t, n, take, amount, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, {"room": rooms.get(key, 0), "last": {}})
        before, ok = s["room"], None
        if take:
            ok = amount <= s["room"]
            s["room"] -= amount if ok else 0
            if tie is not None:
                s["last"][tie] = amount if ok else 0
        else:
            s["room"] += amount if tie is None else s["last"].pop(tie, 0)
        out.append((key, t, n, ok, before, s["room"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, chunk, tight", [(1, 70, 60), (2, 50, 5000), (4, 10_000, 60)])
def test_walk_equals_the_plain_loop(spark, seed, chunk, tight):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        key = rng.choice(["hot", "hot", "a", "b", None])
        kind = rng.random()
        tie = None if kind < 0.3 else f"t{rng.randint(0, 150)}"
        rows.append((key, ts(rng.randint(0, 200)), i, rng.random() < 0.6, rng.randint(0, 40), tie))
    rooms = {"hot": tight, "a": 100, None: 50}
    room = spark.createDataFrame(list(rooms.items()), "key string, room long")
    got = bounded_walk(spark.createDataFrame(rows, ROWS), "key", ["ts", "n"], room, chunk)
    got = sorted((tuple(r) for r in got.select("key", "ts", "n", "accepted", "room_before", "room_after").collect()), key=repr)
    assert got == plain(rows, rooms)


def test_refusal_far_before_its_give(spark):
    rows = [("k", ts(i), i, True, 10, f"o{i}") for i in range(30)] + [("k", ts(100 + i), 100 + i, False, 0, f"o{i}") for i in range(30)]
    rows += [("k", ts(300 + i), 300 + i, True, 9, None) for i in range(20)]
    room = spark.createDataFrame([("k", 95)], "key string, room long")
    got = bounded_walk(spark.createDataFrame(rows, ROWS), "key", ["ts", "n"], room, 25)
    got = sorted((tuple(r) for r in got.select("key", "ts", "n", "accepted", "room_before", "room_after").collect()), key=repr)
    assert got == plain(rows, {"k": 95})


def test_empty_and_missing_rooms(spark):
    none = spark.createDataFrame([], ROWS)
    assert bounded_walk(none, "key", ["ts", "n"]).count() == 0
    one = spark.createDataFrame([("x", ts(1), 1, True, None, None), ("x", ts(2), 2, True, 1, None)], ROWS)
    assert [r["accepted"] for r in bounded_walk(one, "key", ["ts", "n"]).orderBy("n").collect()] == [True, False]


def test_rules_do_not_depend_on_the_chunks(spark):
    rng = random.Random(9)
    orders = [(f"o{i}", "hot" if i % 3 else f"c{i % 5}", ts(i), float(rng.randint(10, 900)) / 10) for i in range(200)]
    rel = [(o, c, t + dt.timedelta(hours=rng.randint(1, 40))) for o, c, t, _ in orders if rng.random() < 0.6]
    o = spark.createDataFrame(orders, "order_id string, customer_id string, created_at timestamp, total_value double")
    r = spark.createDataFrame(rel, "order_id string, customer_id string, timestamp timestamp")
    c = spark.createDataFrame([("hot", 300.0), ("c0", 120.5)], "customer_id string, credit_limit double")
    runs = [sorted(repr((*x[:-1], round(x[-1], 6))) for x in credit_check(o, r, c, chunk=n).collect()) for n in (60, 50_000)]
    assert runs[0] == runs[1] and len(runs[0]) == len(orders) + len(rel)
    rec = spark.createDataFrame([("s", ts(8 * i), f"p{i}", 40) for i in range(20)], "sku_id string, timestamp timestamp, ref string, quantity long")
    dem = spark.createDataFrame([("s", ts(i), f"d{i}", rng.randint(1, 14)) for i in range(160)], "sku_id string, timestamp timestamp, ref string, quantity long")
    runs = [sorted(map(repr, allocate(rec, dem, chunk=n).collect())) for n in (60, 50_000)]
    assert runs[0] == runs[1]
