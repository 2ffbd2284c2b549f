"""project_all writes every table and reads it back; the lazy log prunes to one branch."""

import tempfile

from conftest import SF_TINY

from wholesail.operators.projections import PROJECTIONS, project_all
from wholesail.sources.adapter import build_log
from wholesail.sources.eventlog import read_events
from wholesail.sources.logstore import stored_log


def test_project_all_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="wholesail-test-proj-", dir="/tmp")
    tables = project_all(stored_log(spark, SF_TINY), out)
    assert sorted(tables) == sorted(PROJECTIONS)
    assert tables["orders"].count() > 0


def test_lazy_log_prunes_other_branches(spark):
    plan = read_events(build_log(spark, SF_TINY), "InvoiceCreated")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in plan          # the invoice branch reads orders ...
    assert "l_linenumber" not in plan    # ... and every fixed-type line / stock / promotion branch is gone
