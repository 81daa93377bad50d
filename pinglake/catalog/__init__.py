"""All named queries."""

from . import composites, files, grids, lines, models, windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
