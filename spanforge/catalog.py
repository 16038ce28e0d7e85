"""Every registered query of the library and its oracle SQL."""

from __future__ import annotations

from .registered import ORACLES, QUERIES, aliases, candidates, entity, evidence, further, ingest, ledger, metrics, more, parts, review, streams, terms, text

__all__ = ["ORACLES", "QUERIES", "aliases", "candidates", "entity", "evidence", "further", "ingest", "ledger", "metrics", "more", "parts", "review", "streams", "terms", "text"]
