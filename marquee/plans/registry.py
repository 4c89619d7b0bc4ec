"""All queries of the library and their SQL."""

from __future__ import annotations

from . import agenda, cards, curate, groups, kept, lookups, more, ordered, rules, social, sources, state, streams, text, venues

MODULES = (agenda, cards, curate, groups, kept, lookups, more, ordered, rules, social, sources, state, streams, text, venues)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
