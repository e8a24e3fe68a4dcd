"""All registered queries."""

from bridge import basic, evaluated, jobs, timed  # noqa: F401
from bridge.registry import QUERIES

__all__ = ["QUERIES"]
