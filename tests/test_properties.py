"""Property-based checks in the spirit of the reference's rule and ledger tests."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wholesail.operators.credit import credit_check

events = st.lists(
    st.tuples(st.integers(0, 3), st.floats(1, 500, allow_nan=False), st.integers(0, 40), st.booleans()),
    min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(evs=events, limit=st.floats(50, 1500, allow_nan=False))
def test_credit_used_stays_within_limit(spark, evs, limit):
    t0 = dt.datetime(2024, 1, 1)
    orders, releases = [], []
    for i, (c, amt, h, rel) in enumerate(evs):
        orders.append((f"o{i}", f"c{c}", t0 + dt.timedelta(hours=h, seconds=i), float(amt)))
        if rel:
            releases.append((f"o{i}", f"c{c}", t0 + dt.timedelta(hours=h + 5, seconds=i)))
    o = spark.createDataFrame(orders, "order_id string, customer_id string, created_at timestamp, total_value double")
    r = spark.createDataFrame(releases, "order_id string, customer_id string, timestamp timestamp")
    cu = spark.createDataFrame([(f"c{c}", float(limit)) for c in range(4)], "customer_id string, credit_limit double")
    for row in credit_check(o, r, cu).collect():
        assert -1e-9 <= row["used_after"] <= limit + 1e-9
