"""All queries of the library by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import choices, judging, marking, matches, reports, seeking, texts

MODULES = (reports, choices, texts, matches, judging, marking, seeking)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
