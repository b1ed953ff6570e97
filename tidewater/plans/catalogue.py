"""All queries of this engine by name, and their SQL twins."""

from __future__ import annotations

from . import federation, learning, raw, signals

MODULES = (signals, learning, federation, raw)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
