"""References to records that do not exist, by a co-partitioned linear merge.

``merge_pointers`` brings pointers and the records they name into the same tasks, sorts both by
(target, scope, key) with the records first, and walks the merged stream once: a running minimum
carries the record's validity interval to the pointers behind it.  Hot keys are split into shards
and only their records are replicated (see ``balance``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.balance import co_partition, place_fragments, place_replicas, plan_placement

KEYS = ("target", "scope_id", "key")


def validity(records: DataFrame, target: str) -> DataFrame:
    """One validity interval per record, from ``live_from`` to ``died``: the earliest added_at of its live
    rows and no end if some row is live (``live`` 1), else the latest deleted_at of its rows (``live`` 0)."""
    return (
        records.filter(F.col("id").isNotNull())
        .groupBy("scope_id", F.col("id").alias("key"))
        .agg(
            F.min(F.when(F.col("deleted_at").isNull(), F.col("added_at"))).alias("live_from"),
            F.max(F.when(F.col("deleted_at").isNull(), 1).otherwise(0)).alias("live"),
            F.max("deleted_at").alias("died"),
        )
        .withColumn("target", F.lit(target))
    )


def pointers(rows: DataFrame, table: str, field: str, target: str, at: str) -> DataFrame:
    """One pointer per row with a non-null field; ``month_end`` is the first instant after the
    month in which the row was seen."""
    month = F.date_trunc("month", F.col(at))
    return rows.filter(F.col(field).isNotNull()).select(
        F.lit(target).alias("target"),
        "scope_id",
        F.col(field).alias("key"),
        F.lit(table).alias("table_name"),
        F.lit(field).alias("field_name"),
        F.col("id").alias("row_id"),
        F.date_format(F.col(at), "yyyy-MM").alias("period"),
        F.add_months(month, 1).cast("timestamp_ntz").alias("month_end"),
    )


def merge_pointers(pointer_rows: DataFrame, intervals: DataFrame, tasks: int | None = None) -> DataFrame:
    """Judge every pointer.  Adds ``reason``: null (good), 'missing' (no row of the record in that
    scope), 'deleted' (rows, but none live, and the last was deleted before the pointer's month was over),
    'deleted-later' (the last was deleted only after that month) or 'late' (live, but added after the
    pointer's month).

    A null scope matches only a null scope; a pointer without a time can't be late; a record whose
    live rows have no added_at is late for every pointer with a time.
    """
    placement = plan_placement(pointer_rows, KEYS, tasks)
    left = place_fragments(pointer_rows, placement, ["row_id", "period"]).select("*", F.lit(1).alias("side"), F.lit(None).cast("timestamp_ntz").alias("live_from"), F.lit(None).cast("int").alias("live"), F.lit(None).cast("timestamp_ntz").alias("died"))
    right = place_replicas(intervals, placement).select(
        "_token", *KEYS, F.lit(0).alias("side"), F.col("live_from").cast("timestamp_ntz").alias("live_from"), "live", F.col("died").cast("timestamp_ntz").alias("died")
    )
    both = co_partition(left.unionByName(right, allowMissingColumns=True), placement)
    stream = W.partitionBy("_token", *KEYS).orderBy("side").rowsBetween(W.unboundedPreceding, 0)
    live_from, live, died = F.min("live_from").over(stream), F.max("live").over(stream), F.max("died").over(stream)
    merged = both.select("side", *KEYS, "table_name", "field_name", "row_id", "period", "month_end", live_from.alias("since"), live.alias("is_live"), died.alias("until"))
    reason = (
        F.when(F.col("is_live").isNull(), "missing")
        .when((F.col("is_live") == 0) & (F.col("until") >= F.col("month_end")), "deleted-later")
        .when(F.col("is_live") == 0, "deleted")
        .when(F.col("month_end").isNotNull() & (F.col("since").isNull() | (F.col("since") >= F.col("month_end"))), "late")
    )
    return merged.filter("side = 1").select("table_name", "field_name", "row_id", "period", *KEYS, reason.alias("reason"))


def code_graph_pointers(refs: DataFrame, symbols: DataFrame, files: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pointers of the code graph and the records they name.  Ids of shared symbols are good
    from every scope, so pointers at them leave before the shuffle."""
    own = refs.select("scope_id", "id", "symbol_id", "file_id", "seen_at")
    ids = shared.select(F.col("id").alias("key")).distinct()
    at_symbols = pointers(own, "refs", "symbol_id", "symbols", "seen_at").join(ids, "key", "left_anti")
    live = symbols.filter(F.col("deleted_at").isNull()).select("scope_id", "id", "file_id", "added_at")
    rows = (
        at_symbols.unionByName(pointers(own, "refs", "file_id", "files", "seen_at"))
        .unionByName(pointers(live, "symbols", "file_id", "files", "added_at"))
    )
    columns = ["scope_id", "id", "added_at", "deleted_at"]
    return rows, validity(symbols.select(*columns), "symbols").unionByName(validity(files.select(*columns), "files"))


def find_orphans(refs: DataFrame, symbols: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, period, reason) of every broken pointer, without repeats.
    Null fields are no pointers; zero and negative values are judged like others; empty tables
    give an empty result or, for targets, only 'missing'."""
    rows, intervals = code_graph_pointers(refs, symbols, files, shared)
    broken = merge_pointers(rows, intervals).filter(F.col("reason").isNotNull())
    return broken.select("table_name", "field_name", "row_id", "period", "reason").distinct()


def report_orphans(orphans: DataFrame) -> DataFrame:
    """Broken pointers counted per table, field, period and reason."""
    return orphans.groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n_rows"))
