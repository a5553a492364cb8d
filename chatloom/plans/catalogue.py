"""All registered queries over the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

from . import io, live, memory, split, trace, watch  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
