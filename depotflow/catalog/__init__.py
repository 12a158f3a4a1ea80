"""Named queries with the SQL they are checked against."""

from depotflow.catalog import checks, documents, flows, integrity, reports  # noqa: F401
from depotflow.catalog.registry import QUERIES

__all__ = ["QUERIES"]
