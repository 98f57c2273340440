"""All registered queries, importable in one place."""

from __future__ import annotations

from storelens.plans import (  # noqa: F401  (registration)
    activity_queries, document_queries, retrieval_queries, seed_queries, store_queries, stream_queries)
from storelens.plans.registry import REGISTRY


def queries():
    return {name: e.build for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.oracle for name, e in REGISTRY.items() if e.oracle}
