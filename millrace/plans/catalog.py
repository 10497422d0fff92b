"""All queries of the engine by name, and the SQL that should return the same rows."""

from __future__ import annotations

from . import checks, cleaning, etl, files, ingest, ledgers, map, mapping, people, relational, stores, streams, textual, web  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
