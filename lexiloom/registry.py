"""All queries of the library's own operators, by name, and their SQL."""

from .plans import QUERIES, SQL

ORACLES = SQL

__all__ = ["ORACLES", "QUERIES"]
