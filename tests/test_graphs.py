"""Causal chains and shared groups against plain walks; cycles, gaps, hubs, nulls."""

import random

import pytest

from wholesail.operators import graphs as G


def chains(rows):
    up = {}
    for i, c in rows:
        if i is not None:
            up[i] = min((x for x in (up.get(i), c) if x is not None), default=None)
    out = []
    for i in up:
        at, depth, seen = i, 0, set()
        while up[at] in up and at not in seen:
            seen.add(at)
            at, depth = up[at], depth + 1
        out.append((i, None, None, None, True) if at in seen else (i, at, depth, up[at], False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [("r", None), ("lone", None), (None, "r"), ("x", "nowhere"), ("loop", "loop"), ("a", "b"), ("b", "c"), ("c", "a"), ("tail", "b"), ("tail2", "tail")]
    rows += [(f"l{i}", f"l{i - 1}" if i else "r") for i in range(70)]  # a long chain
    rows += [(f"h{i}", "r") for i in range(60)]  # a hub
    rows += [(f"g{i}", f"g{rng.randint(0, 200)}" if rng.random() < 0.9 else None) for i in range(150)]  # gaps and cycles
    rows += [("l5", "l4"), ("h1", None)]  # repeated ids
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id string, causation_id string")
    assert sorted((tuple(r) for r in G.causal_chains(df).collect()), key=repr) == chains(rows)


def test_no_events(spark):
    assert G.causal_chains(spark.createDataFrame([], "event_id string, causation_id string")).count() == 0


def groups(rows, most):
    by = {}
    for c, v in rows:
        if c is not None and v is not None:
            by.setdefault(v, set()).add(c)
    label = {c: c for c, _ in rows if c is not None}
    changed = True
    while changed:
        changed = False
        for members in by.values():
            if most is None or len(members) <= most:
                low = min(label[c] for c in members)
                for c in members:
                    changed |= label[c] != low
                    label[c] = low
    return sorted((c, g, sum(x == g for x in label.values())) for c, g in label.items())


@pytest.mark.parametrize("seed, most", [(1, None), (2, 3), (3, 5)])
def test_groups_equal_plain_labels(spark, seed, most):
    rng = random.Random(seed)
    rows = [(f"c{rng.randint(0, 120)}", f"v{rng.randint(0, 140)}") for _ in range(180)]
    rows += [(f"p{i}", f"e{i}") for i in range(40)] + [(f"p{i + 1}", f"e{i}") for i in range(40)]  # a path
    rows += [(f"h{i}", "hub") for i in range(30)] + [("n", None), (None, "e1"), ("h1", "hub")]
    df = spark.createDataFrame(rows, "customer_id string, value string")
    assert sorted(tuple(r) for r in G.shared_groups(df, most).collect()) == groups(rows, most)


def test_risk_spreads_inside_a_group(spark):
    g = spark.createDataFrame([("a", "a", 2), ("b", "a", 2), ("c", "c", 1)], "customer_id string, group_id string, members long")
    c = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "customer_id string, risk_score double")
    got = {r["customer_id"]: (r["group_risk"], r["spread_risk"]) for r in G.shared_risk(g, c).collect()}
    assert got == {"a": (0.9, 0.9), "b": (0.9, pytest.approx(0.5)), "c": (0.0, 0.0)}
