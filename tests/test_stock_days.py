"""Stock as validity intervals and as-of days, against plain sums."""

import datetime as dt
import random

from wholesail.operators.inventory import stock_intervals, stock_on_days

MOVES = "sku_id string, timestamp timestamp, received long, reserved long, released long"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def at(n, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)


def test_days_equal_plain_sums(spark):
    rng = random.Random(4)
    moves = [(rng.choice(["a", "b", "hot", "hot"]), at(rng.randint(0, 200), rng.randint(0, 23)), *rng.choice([(9, None, None), (None, 4, None), (None, None, 3)])) for _ in range(150)]
    outs = [("hot", at(40, 3)), ("hot", at(40, 5)), ("a", at(7))]
    asked = [(s, day(n)) for s in ("a", "b", "hot", "new") for n in (-3, 0, 7, 40, 41, 130, 199, 400)]
    m = spark.createDataFrame(moves, MOVES)
    got = stock_on_days(stock_intervals(m), spark.createDataFrame(asked, "sku_id string, day date"), spark.createDataFrame(outs, "sku_id string, timestamp timestamp"))
    want = []
    for s, d in asked:
        mine = [x for x in moves if x[0] == s and x[1].date() <= d]
        on_hand = sum(x[2] or 0 for x in mine)
        reserved = sum((x[3] or 0) - (x[4] or 0) for x in mine)
        n = sum(o[0] == s and o[1].date() == d for o in outs)
        want.append((s, d, on_hand, reserved, on_hand - reserved, n, n > 0))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_intervals_meet(spark):
    moves = [("a", at(1, 5), 5, None, None), ("a", at(1, 9), None, 2, None), ("a", at(4), None, 1, None), ("b", at(2), 7, None, None)]
    got = sorted((tuple(r) for r in stock_intervals(spark.createDataFrame(moves, MOVES)).collect()), key=str)
    assert got == sorted([("a", day(1), day(3), 5, 2, 3), ("a", day(4), None, 5, 3, 2), ("b", day(2), None, 7, 0, 7)], key=str)
    assert stock_intervals(spark.createDataFrame([], MOVES)).count() == 0
