"""All queries of the reference's operators and their oracle SQL."""

from __future__ import annotations

import importlib

from tidewire.plans.registry import ORACLES, QUERIES

MODULES = ["overview", "articles", "vectors", "observability", "density", "intelligence", "pages", "briefs", "monitoring"]
for _name in MODULES:
    importlib.import_module(f"tidewire.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
