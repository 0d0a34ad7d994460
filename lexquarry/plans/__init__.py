"""Named queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lexquarry.plans import evidence_queries, graph_queries, ledger_queries, library_queries, listing_queries, output_queries, record_queries, repair_queries, retrieval_queries, rewriting_queries, rule_queries, structure_queries, upkeep_queries

_MODULES = (retrieval_queries, graph_queries, ledger_queries, library_queries, rule_queries, record_queries, upkeep_queries, structure_queries, rewriting_queries, output_queries, repair_queries, listing_queries, evidence_queries)


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
