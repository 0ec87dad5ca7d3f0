"""Named queries, and the SQL that says the same where SQL can."""

from __future__ import annotations

from tabularium.plans import building, cascades, checks, columns, extraction, labels, merges, precincts, results, routes, rules, segments, sequences, services, stores, streams, structures, texts, trees, vectors

FLAGSHIP = "wide_pivot_totals"
_ALL = results.QUERIES | texts.QUERIES | routes.QUERIES | sequences.QUERIES | checks.QUERIES | trees.QUERIES | vectors.QUERIES | streams.QUERIES | structures.QUERIES | rules.QUERIES | extraction.QUERIES | stores.QUERIES | cascades.QUERIES | merges.QUERIES | labels.QUERIES | services.QUERIES | building.QUERIES | columns.QUERIES | segments.QUERIES | precincts.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
