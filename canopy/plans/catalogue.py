"""All catalogue queries (importing a module registers its queries)."""

from __future__ import annotations

from canopy.plans import (  # noqa: F401
    q_lookup, q_misc, q_ml, q_search, q_sources, q_state, q_stream, q_structured, q_topics, q_tree, q_vectors)
from canopy.plans.registry import REGISTRY


def queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
