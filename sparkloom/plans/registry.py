"""All queries of the library by name, with the SQL each is held against."""

from __future__ import annotations

from . import board, chunking, crawl, maintenance, pages, search, statistics, streams, tables  # noqa: F401  they register queries
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
