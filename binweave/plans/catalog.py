"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from binweave.plans import aggregates, files, filters, linked, matrix, relations, restarting, wholes  # noqa: F401
from binweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
