"""All queries of the core, collected from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from . import extra, gold, measures, pipeline_problems, silver, text

MODULES = [pipeline_problems, silver, gold, text, measures, extra]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
