"""All queries of the engine and their SQL."""

from __future__ import annotations

from quillsieve.plans import queries_answers, queries_arms, queries_labels, queries_measure, queries_offline, queries_stats, queries_text

PARTS = [queries_text, queries_arms, queries_answers, queries_stats, queries_labels, queries_measure, queries_offline]
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in PARTS for k, v in part.SQL.items()}
