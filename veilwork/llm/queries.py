"""The queries of this subpackage and the SQL stating their results."""

from __future__ import annotations

from . import (codes, fingerprints, html, language, mixing, neighbours, packing, repetition, scoring, search, similar,
               subwords, toxicity)

_MODULES = (html, subwords, toxicity, similar, repetition, neighbours, packing, language, scoring, mixing, codes, fingerprints,
            search)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
