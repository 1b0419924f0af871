"""All queries of the engine's own operators."""

from __future__ import annotations

from marlstone.plans import catalog, chat, files, impact, records, retrieval, review, search, standards, texts, usage, workflow  # noqa: F401  they register themselves
from marlstone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
