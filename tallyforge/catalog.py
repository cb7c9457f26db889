"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from .plans import analytic, archives, columns, feeds, form, more, relational, reports, scoring, selection, squads, texts
from .plans.base import Query

MODULES = [relational, analytic, scoring, texts, more, form, columns, reports, feeds, selection, archives, squads]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.plans.sql.items()}
