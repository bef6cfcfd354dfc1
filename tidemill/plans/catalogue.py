"""All registered queries."""

from tidemill.plans import (  # noqa: F401
    aggregates, changes, files, intervals, nested, quality, relational, reports, scalar, sources, streams, udfs, windows)
from tidemill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
