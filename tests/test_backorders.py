"""Backorders against a queue replayed unit by unit; a hot SKU and hot days included."""

import datetime as dt
import random

import pytest

from wholesail.operators.inventory import backorder_fulfilment, open_orders

NEED = "sku_id string, timestamp timestamp, order_id string, shortfall long"
SUPPLY = "sku_id string, timestamp timestamp, ref string, quantity long"


def ts(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def replay(needs, supply):
    out = []
    events = sorted([(t, 1, o, n, s) for s, t, o, n in needs] + [(t, 0, r, q, s) for s, t, r, q in supply])
    for sku in {e[4] for e in events}:
        queue = []
        for t, kind, ref, n, s in events:
            if s != sku or n <= 0:
                continue
            if kind:
                queue.append([ref, t, n, n])
                continue
            while n and queue:
                first = queue[0]
                part = min(n, first[3])
                out.append((sku, first[0], first[1], first[2], part, t, ref))
                n -= part
                first[3] -= part
                if not first[3]:
                    queue.pop(0)
        out += [(sku, r, t, n, left, None, None) for r, t, n, left in queue]
    return sorted(out, key=repr)


def run(spark, needs, supply):
    df = backorder_fulfilment(spark.createDataFrame(needs, NEED), spark.createDataFrame(supply, SUPPLY))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_supply_before_the_backorder_counts_nothing(spark):
    assert run(spark, [("s", ts(240), "o", 5)], [("s", ts(24), "po", 100)]) == [("s", "o", ts(240), 5, 5, None, None)]


def test_parts_and_order_of_arrival(spark):
    got = run(spark, [("s", ts(1), "a", 5), ("s", ts(2), "b", 4)], [("s", ts(3), "p", 6), ("s", ts(3), "q", 1), ("s", ts(90), "r", 50), ("t", ts(5), "x", 9)])
    assert got == sorted([("s", "a", ts(1), 5, 5, ts(3), "p"), ("s", "b", ts(2), 4, 1, ts(3), "p"), ("s", "b", ts(2), 4, 1, ts(3), "q"), ("s", "b", ts(2), 4, 2, ts(90), "r")], key=repr)


@pytest.mark.parametrize("seed, most", [(1, 8), (2, 3000), (3, 40)])
def test_equals_a_replayed_queue(spark, seed, most):
    rng = random.Random(seed)
    sku = lambda: "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 4)}"
    hour = lambda: rng.choice([5, 5, rng.randint(0, 600)])
    needs = [(sku(), ts(hour()), f"o{i}", rng.randint(0, most)) for i in range(300)]
    supply = [(sku(), ts(hour()), f"p{i}", rng.randint(0, most)) for i in range(280)]
    assert run(spark, needs, supply) == replay(needs, supply)


def test_empty_sides(spark):
    assert run(spark, [], [("s", ts(1), "p", 5)]) == [] == run(spark, [], [])


def test_open_orders(spark):
    orders = spark.createDataFrame([("a", ts(1), ts(9), 3), ("a", ts(2), None, 4), ("a", ts(1), ts(4), 8), ("b", ts(7), ts(9), 1)],
                                   "sku_id string, po_at timestamp, received_at timestamp, quantity long")
    now = spark.createDataFrame([(ts(5),)], "now timestamp")
    assert [tuple(r) for r in open_orders(orders, now).collect()] == [("a", 7)]
