"""The operators and pipelines bound to the star-schema test tables.

Each module registers queries next to the SQL that must give the same result.
"""

from bindings import aggregates, effort, landings, rows, scalars, specimens  # noqa: F401
from bindings.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
