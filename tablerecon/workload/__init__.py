"""Example queries: every operator over the test tables, with reference SQL."""

from tablerecon.workload import comparing, files, relations, scalars  # noqa: F401
from tablerecon.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
