"""Registered queries over the given tables."""

from importlib import import_module

from faktorium.plans.registry import ORACLES, QUERIES

MODULES = ["totals", "payments", "identifiers", "log_queries", "documents", "rules", "packages", "reference_data", "findings"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"faktorium.plans.{name}")
    return QUERIES, ORACLES
