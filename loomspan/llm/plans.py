"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from loomspan.llm import plans_abuse, plans_leakage, plans_lines, plans_mixing, plans_privacy, plans_sentences, plans_threads, plans_turns

_MODULES = (plans_abuse, plans_lines, plans_turns, plans_threads, plans_privacy, plans_leakage, plans_mixing, plans_sentences)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
