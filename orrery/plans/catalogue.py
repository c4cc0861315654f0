"""Every query over the test tables with its oracle SQL, by name."""

from __future__ import annotations

from orrery.plans import audits, entities, resolution, selection, stores, studies, verdicts

MODULES = (resolution, entities, selection, studies, verdicts, stores, audits)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
