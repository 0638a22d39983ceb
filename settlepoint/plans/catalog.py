"""Registry of the core queries and their oracle SQL."""

from __future__ import annotations

from . import convergence, files, identity, utilities

QUERIES: dict = {}
ORACLES: dict = {}
for module in (convergence, identity, utilities, files):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
