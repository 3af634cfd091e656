"""Every query of the library with its SQL equivalent."""

from __future__ import annotations

from pactline.plans import access, answers, contracts, documents_text, edits, evidence, grounding, lifecycle, parts, repository, store, synthesis, telemetry, text, tree, updates

_PLANS = (telemetry, store, repository, contracts, answers, tree, edits, grounding, evidence, lifecycle, updates, synthesis, documents_text, parts, access, text)


def queries() -> dict:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
