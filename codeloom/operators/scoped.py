"""Which symbol an id means: ids are unique only within a scope, and shared symbols are seen from all.

An id in a row of a scope means that scope's own symbol; where the scope has none with the id, it
means the shared one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.tables import SHARED, GraphTables


def _own(t: GraphTables, ids: DataFrame, column: str) -> DataFrame:
    """(scope, column): the scopes that have a symbol of their own with one of the ids."""
    own = t.symbols.filter(F.col("scope") != SHARED).select("scope", F.col("id").alias(column))
    return own.join(ids.select(column).distinct(), column, "left_semi").distinct().withColumn("_own", F.lit(True))


def pointing_at(t: GraphTables, rows: DataFrame, column: str, targets: DataFrame, name: str | None = None) -> DataFrame:
    """Rows whose ``column`` means one of the targets (scope, id); with ``name`` the target's scope is
    added.  Targets are few; the rows are read once."""
    few = targets.select(F.col("scope").alias("_to"), F.col("id").alias(column)).distinct()
    hit = rows.join(few, column).filter((F.col("scope") == F.col("_to")) | (F.col("_to") == SHARED))
    own = _own(t, few.filter(F.col("_to") == SHARED), column)
    kept = hit.join(own, ["scope", column], "left").filter((F.col("scope") == F.col("_to")) | F.col("_own").isNull())
    return kept.select(*rows.columns, *([F.col("_to").alias(name)] if name else []))


def with_target_scope(t: GraphTables, rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the scope of the symbol that ``column`` means.  Ids that no symbol has keep the row's scope.
    Both sides that are joined are about shared ids alone; hot ids are split by AQE's skew join."""
    shared = t.symbols.filter(F.col("scope") == SHARED).select(F.col("id").alias(column)).distinct()
    marked = rows.join(shared.withColumn("_shared", F.lit(True)), column, "left").join(_own(t, shared, column), ["scope", column], "left")
    scope = F.when(F.col("_shared") & F.col("_own").isNull(), F.lit(SHARED)).otherwise(F.col("scope"))
    return marked.select(*rows.columns, scope.alias(name))


def resolvable(t: GraphTables, rows: DataFrame, column: str, among: DataFrame | None = None, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` means a symbol that exists, or one ``among`` (scope, id); with ``how``
    left_anti the other rows."""
    ids = (t.symbols if among is None else among).select(F.col("scope").alias("_to"), F.col("id").alias(column)).distinct()
    return with_target_scope(t, rows, column, "_to").join(ids, ["_to", column], how).select(*rows.columns)
