"""Sampler invariants: disjoint order-keyed samples, exact caps, and foreign keys in preserve mode."""

import pytest

from conftest import SF_SMALL

from wholesail.operators.sampling import cap_sizes, manifest
from wholesail.plans import q_sampling as QS


def test_compat_and_preserve_modes(spark):
    compat = QS.run(spark, SF_SMALL, cap=1500)
    a, b = compat.samples["sample_a"], compat.samples["sample_b"]
    assert a["orders"].join(b["orders"], "order_id").count() == 0          # disjoint anchors
    rows = {(r["sample"], r["table"]): r["rows"] for r in manifest(compat).collect()}
    total_a = sum(v for (s, _), v in rows.items() if s == "sample_a")
    assert total_a <= 1500 + len(QS.SAMPLE_TABLES)                          # proportional trim (floor, ≥1)
    pres = QS.run(spark, SF_SMALL, cap=1500, preserve_keys=True)
    pa = pres.samples["sample_a"]
    # every child row's key exists in the trimmed anchor (no broken foreign keys)
    assert pa["order_lines"].join(pa["orders"], "order_id", "left_anti").count() == 0
    assert pa["invoices"].join(pa["orders"], "order_id", "left_anti").count() == 0
    assert pa["payments"].join(pa["invoices"], "invoice_id", "left_anti").count() == 0
    assert pa["customers"].join(pa["orders"], "customer_id", "left_anti").count() == 0
    # the anchor was trimmed to the cap arithmetic
    counts = {r["table"]: r["rows"] for r in manifest(QS.run(spark, SF_SMALL, cap=None)).collect()
              if r["sample"] == "sample_a"}
    want = cap_sizes({t: counts[t] for t in QS.SAMPLE_TABLES}, 1500)["orders"]
    assert pa["orders"].count() == want


def test_config_file(spark, tmp_path):
    import json

    from wholesail.operators import sampling as G

    raw = {
        "random_seed": 7, "date_window": {"anchor": "latest", "days": 30}, "stratify_by": ["channel"],
        "samples": [{"name": "a", "split": "even"}], "target_rows": 5,
        "tables": [{"name": "orders", "split_anchor": True, "filter": "date_window"},
                   {"name": "lines", "join": {"parent": "orders", "key": "order_id"}}, {"name": "skus", "static": True}],
    }
    path = tmp_path / "sampler.json"
    path.write_text(json.dumps(raw))
    cfg = G.load_config(spark, str(path))
    assert (cfg.random_seed, cfg.days, cfg.target_rows, cfg.samples[0].name) == (7, 30, 5, "a")
    assert cfg.tables[1].join == G.JoinSpec("orders", "order_id")
    raw["tables"][2]["split_anchor"], raw["tables"][0]["split_anchor"] = True, False
    path.write_text(json.dumps(raw))
    with pytest.raises(ValueError):
        G.load_config(spark, "file:" + str(path))


def test_written_run_has_sizes_and_totals(spark, tmp_path):
    from wholesail.operators import sampling as G

    run = G.SampleRun(samples={"a": {"t": spark.range(10), "u": spark.range(3)}}, reference={"r": spark.range(2)})
    got = {(r["sample"], r["table"]): (r["rows"], r["size_mb"]) for r in G.write_run(run, str(tmp_path)).collect()}
    assert got[("a", "t")][0] == 10 and got[("a", None)][0] == 13 and got[("reference", None)][0] == 2
    assert all(size >= 0 for _, size in got.values())
