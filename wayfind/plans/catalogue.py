"""All registered queries, by module."""

from __future__ import annotations

from importlib import import_module

from wayfind.plans import registry

MODULES = ("text_plans", "rule_plans", "similarity_plans", "join_plans", "metric_plans", "set_plans", "select_plans", "session_plans", "mining_plans", "retrieval_plans", "slot_plans", "source_plans")


def _load() -> None:
    for name in MODULES:
        import_module(f"wayfind.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.SQL)
