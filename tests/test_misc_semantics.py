"""T1 latest-status tie-break and M7 late-arrival share."""

import datetime as dt

from wholesail.operators.features import session_funnel
from wholesail.operators.windows import latest_by
from wholesail.streaming.metrics import late_share

T = dt.datetime(2024, 1, 1)


def test_latest_status_ties_break_on_event_id(spark):
    df = spark.createDataFrame([("o1", "OrderShipped", T, "e1"), ("o1", "OrderDelivered", T, "e2"),
                                ("o2", "OrderDelivered", T, "e9"), ("o2", "OrderReturned", T + dt.timedelta(1), "e3")],
                               "order_id string, event_type string, timestamp timestamp, event_id string")
    got = {r[0]: r[1] for r in latest_by(df, "order_id", "event_type", ["timestamp", "event_id"], "s").collect()}
    assert got == {"o1": "OrderDelivered", "o2": "OrderReturned"}


def test_events_without_a_session_id_make_sessions_by_pauses(spark):
    at = lambda minutes: T + dt.timedelta(minutes=minutes)
    rows = [(None, "c1", "screen_view", 5, False, at(0)), (None, "c1", "product_search", 5, True, at(20)), (None, "c1", "screen_view", 5, False, at(90)),
            (None, "c2", "screen_view", 5, False, at(10)), ("s", "c1", "screen_view", 5, False, at(0)), ("s", "c1", "screen_view", 5, False, at(300)),
            (None, "c1", "screen_view", 5, False, None)]
    df = spark.createDataFrame(rows, "session_id string, customer_id string, event_subtype string, session_duration_seconds int, "
                                     "led_to_order boolean, timestamp timestamp")
    got = sorted((tuple(r) for r in session_funnel(df).collect()), key=repr)
    assert got == sorted([(None, "c1", 2, 1, 1, 10, True, at(0)), (None, "c1", 1, 1, 0, 5, False, at(90)), (None, "c2", 1, 1, 0, 5, False, at(10)),
                          ("s", "c1", 2, 2, 0, 10, False, at(0)), (None, "c1", 1, 1, 0, 5, False, None)], key=repr)


def test_late_share(spark):
    # arrival batches 0,1,2; batch 1 carries an event 3 days older than batch 0's newest row
    rows = [(0, T + dt.timedelta(days=5)), (0, T + dt.timedelta(days=6)),
            (1, T + dt.timedelta(days=3)), (1, T + dt.timedelta(days=7)),
            (2, T + dt.timedelta(days=6, hours=12)), (2, T + dt.timedelta(days=8))]
    df = spark.createDataFrame(rows, "arrival int, ts timestamp")
    r = late_share(df, "ts", "arrival", delay_us=24 * 3600 * 1_000_000).first()
    # late: (1, day 3) < day 6 − 1d; (2, day 6.5) is not < day 7 − 1d
    assert (r["rows"], r["late"]) == (6, 1)
