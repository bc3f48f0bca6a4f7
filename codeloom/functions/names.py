"""Name and kind expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_kind(column: str | Column) -> Column:
    """Kinds compare without letter case, outer blanks and the choice of ``_`` or ``-``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), "_", "-")
