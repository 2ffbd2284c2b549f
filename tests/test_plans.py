"""Plan guards for every registered batch query: no cartesian product anywhere, and every
nested-loop join broadcasts a global aggregate (exactly one row) — a scalar attached to rows,
never a data-sized side."""

import pytest

from conftest import SF_TINY

import __spark_entry__ as E

NAMES = sorted(n for n in E.queries() if not n.startswith("stream_"))


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _one_row(plan) -> bool:
    """True if the subtree provably yields one row: a global aggregate, possibly under
    projections/filters/exchanges, or a single-row local relation."""
    name = plan.nodeName()
    if "HashAggregate" in name or "SortAggregate" in name or "ObjectHashAggregate" in name:
        return plan.groupingExpressions().size() == 0
    if name in ("LocalTableScan",):
        return True
    if plan.children().size() == 1:
        return _one_row(plan.children().apply(0))
    return False


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_and_scalar_nested_loops(spark, name):
    df = E.queries()[name](spark, SF_TINY)
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text, name
    for node in _nodes(plan):
        nn = node.nodeName()
        if "AdaptiveSparkPlan" in nn:
            for inner in _nodes(node.executedPlan()):
                if inner.nodeName() == "BroadcastNestedLoopJoin":
                    side = inner.right() if inner.buildSide().toString() == "BuildRight" else inner.left()
                    assert _one_row(side), f"{name}: nested-loop join over a non-scalar side"
        if nn == "BroadcastNestedLoopJoin":
            side = node.right() if node.buildSide().toString() == "BuildRight" else node.left()
            assert _one_row(side), f"{name}: nested-loop join over a non-scalar side"
