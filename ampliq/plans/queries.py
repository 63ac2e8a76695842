"""All queries over the driver's tables; importing the modules registers them."""

from __future__ import annotations

from . import queries_edits, queries_files, queries_modes, queries_reads, queries_samples, queries_tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
