"""Registered queries over the driver's tables, with the SQL they are checked against."""

from workload import articles, collect  # noqa: F401
from workload.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
