"""All registered queries outside the llm subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from tidemark.plans import aggregates, board, graph, io, ledger, patterns, pipeline, relational, streams, text, windowed

FAMILIES = (pipeline, relational, aggregates, windowed, text, graph, patterns, board, streams, io, ledger)


def catalog() -> dict:
    out: dict = {}
    for family in FAMILIES:
        twice = out.keys() & family.QUERIES.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= family.QUERIES
    return out


def coverage() -> dict[str, tuple[str, ...]]:
    """Inventory rows by query."""
    out: dict = {}
    for module in FAMILIES:
        if hasattr(module, "family"):
            out |= module.family.coverage
    return out
