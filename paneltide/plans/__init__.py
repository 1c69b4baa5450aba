"""Named queries over the driver tables, each with its SQL oracle where one exists."""

from . import eval_queries, io_queries, ml_queries, panel_queries, relational_queries  # noqa: F401  (registers queries)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
