"""Column references by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of this name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")
