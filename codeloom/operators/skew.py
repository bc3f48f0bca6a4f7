"""Per-key results although a few keys hold most rows: fragment-replicate by estimated load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import normal_kind
from codeloom.operators.balance import co_partition, place_fragments, place_replicas, plan_placement
from codeloom.session import cut


def count_by_key(rows: DataFrame, matching: DataFrame, distinct_by, tasks: int | None = None) -> DataFrame:
    """Distinct ``distinct_by`` per ``symbol_id`` joined with the attributes of the key.

    rows: symbol_id and the distinct_by columns.  matching: one row (symbol_id, name) per key.
    Rows of a heavy key are cut into shards by the hash of distinct_by, so repeats of one record
    meet in one shard; the key's matching row is replicated to exactly these shards.  Each task
    counts its shard; the last step only adds up one row per key and shard.  Null keys are left
    out; keys without rows come out with 0, keys without a matching row with a null name.
    """
    distinct_by = list(distinct_by)
    rows = rows.filter(F.col("symbol_id").isNotNull()).select("symbol_id", *distinct_by)
    placement = plan_placement(rows, ["symbol_id"], tasks)
    left = place_fragments(rows, placement, distinct_by).withColumn("name", F.lit(None).cast("string"))
    right = place_replicas(matching.filter(F.col("symbol_id").isNotNull()).select("symbol_id", "name"), placement)
    both = co_partition(left.unionByName(right, allowMissingColumns=True), placement)
    records = F.struct(*distinct_by)
    is_row = F.coalesce(*[F.col(c).cast("string") for c in distinct_by]).isNotNull()
    shards = both.groupBy("_token", "symbol_id").agg(
        F.count_distinct(F.when(is_row, records)).alias("n"), F.max("name").alias("name")
    )
    return shards.groupBy("symbol_id").agg(F.sum("n").alias("n"), F.max("name").alias("name"))


def key_names(symbols: DataFrame, shared: DataFrame) -> DataFrame:
    """One name per known symbol id (the greatest, should rows differ)."""
    every = symbols.select("id", "name").unionByName(shared.select("id", "name"))
    return every.groupBy(F.col("id").alias("symbol_id")).agg(F.max("name").alias("name"))


def reference_loads(refs: DataFrame, symbols: DataFrame, shared: DataFrame) -> DataFrame:
    """(symbol_id, name, n): distinct refs.id per symbol."""
    return count_by_key(refs.select("symbol_id", "id"), key_names(symbols, shared), ["id"])


def call_loads(edges: DataFrame, symbols: DataFrame, shared: DataFrame) -> DataFrame:
    """(symbol_id, name, n): distinct callers (scope_id, src) per edges.dst; the kind's letter
    case, outer blanks and underscores don't matter."""
    calls = edges.filter(normal_kind("kind_name") == "calls").select(F.col("dst").alias("symbol_id"), "scope_id", "src")
    return count_by_key(calls.filter(F.col("src").isNotNull()), key_names(symbols, shared), ["scope_id", "src"])


def heavy_symbols(loads: DataFrame, total: int, measure: str, percent: int = 2) -> DataFrame:
    """Symbols that hold at least ``percent`` % of ``total``; none if there is nothing to hold."""
    few = loads.filter((F.col("n") > 0) & (F.col("n") * 100 >= F.lit(total or 0) * percent))
    return few.select(F.lit(measure).alias("measure"), "symbol_id")


def find_heavy(refs: DataFrame, edges: DataFrame, symbols: DataFrame, shared: DataFrame, percent: int = 2) -> DataFrame:
    """(measure, symbol_id) of the few symbols that own most rows.  The counts are materialised
    once, since the sum of all in-degrees needs them before the comparison."""
    by_refs, by_calls = reference_loads(refs, symbols, shared), cut(call_loads(edges, symbols, shared))
    n_refs = refs.filter(F.col("symbol_id").isNotNull()).agg(F.count_distinct("id")).first()[0]
    n_calls = by_calls.agg(F.sum("n")).first()[0]
    return heavy_symbols(by_refs, n_refs, "refs", percent).unionByName(heavy_symbols(by_calls, n_calls, "calls", percent))
