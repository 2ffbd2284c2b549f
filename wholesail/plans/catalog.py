"""Import every query module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["q_projections", "q_decision", "q_cookbook", "q_quality", "q_sampling", "q_rules", "q_streaming", "q_misc", "q_graphs", "q_funnel"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"wholesail.plans.{m}")


load()
