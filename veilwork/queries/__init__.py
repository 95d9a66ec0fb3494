"""The registered queries and the SQL stating their expected results."""

from __future__ import annotations

from . import analysis, generators, runs, sources, uniqueness, verification

_MODULES = (generators, sources, runs, uniqueness, analysis, verification)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
