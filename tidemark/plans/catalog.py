"""Registered queries of the library, and their SQL."""

from __future__ import annotations

from tidemark.plans import queries, stores
from tidemark.plans.oracle import ORACLES as ORACLES

QUERIES = {name: f for module in (queries, stores) for name, f in vars(module).items() if name.startswith("kv_") and callable(f) and f.__module__ == module.__name__}
