"""All core queries and their SQL twins."""

from __future__ import annotations

from loomspan.plans import archives, comments, descriptions, extractions, flows, history, listings, mirror, requests, state, texts, transcripts

_MODULES = (history, texts, comments, descriptions, archives, requests, transcripts, extractions, flows, listings, mirror, state)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
