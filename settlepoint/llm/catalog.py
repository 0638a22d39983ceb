"""Registry of the training-data queries."""

from __future__ import annotations

from . import queries
from .oracles import ORACLES  # noqa: F401

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
