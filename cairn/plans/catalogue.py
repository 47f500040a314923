"""Every registered query of the engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_corpus, queries_reports, queries_retrieval

QUERIES = {**queries_retrieval.QUERIES, **queries_corpus.QUERIES, **queries_reports.QUERIES}
ORACLES = {**queries_retrieval.ORACLES, **queries_corpus.ORACLES, **queries_reports.ORACLES}
