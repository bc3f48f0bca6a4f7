"""Queries that read JSON payloads of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.scoped import with_target_scope
from codeloom.tables import GraphTables


def payload_value(key: str, column: str = "payload") -> Column:
    """A top-level value as text; null for null, empty and damaged payloads."""
    sound = F.try_parse_json(F.col(column)).isNotNull()
    return F.when(sound, F.get_json_object(F.col(column), f"$['{key}']"))


def two_sided(t: GraphTables, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with both symbols and the paths of their files (null where a side has no file); with
    ``how`` left, edges whose target doesn't exist stay, with nulls."""
    files = t.files.select("scope", F.col("id").alias("file_id"), "path")
    named = t.symbols.join(files, ["scope", "file_id"], "left")
    source = named.select("scope", F.col("id").alias("src"), F.col("canonical_key").alias("src_key"), F.col("fqn").alias("src_fqn"), F.col("path").alias("src_path"), F.col("start_line").alias("src_line"))
    target = named.select(F.col("scope").alias("dst_scope"), F.col("id").alias("dst"), F.col("canonical_key").alias("dst_key"), F.col("fqn").alias("dst_fqn"), F.col("path").alias("dst_path"))
    meant = with_target_scope(t, edges.join(source, ["scope", "src"]), "dst", "dst_scope")
    return meant.join(target, ["dst_scope", "dst"], how)


def _page(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.col("src_path").asc_nulls_first(), F.col("src_line").asc_nulls_first(), "src_fqn", "dst_fqn", "src", "dst", "kind_name").limit(limit)


def find_data_bindings(t: GraphTables, target: str | None = None, source: str | None = None, path: str | None = None, mode: str | None = None, converter: str | None = None, limit: int = 50) -> DataFrame:
    """binds-path edges; the path is a case-sensitive part of the payload's."""
    rows = t.edges.filter("kind_name = 'binds-path'").select("*", *[payload_value(k).alias(k) for k in ("path", "mode", "converter")])
    if path is not None:
        rows = rows.filter(F.instr("path", path) > 0)
    for column, value in (("mode", mode), ("converter", converter)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    both = two_sided(t, rows)
    both = both if target is None else both.filter(F.col("dst_key") == target)
    both = both if source is None else both.filter(F.col("src_key") == source)
    return _page(both, limit).select("scope", "src_fqn", "dst_fqn", "path", "mode", "converter", "src_path", "src_line")


def find_event_handlers(t: GraphTables, handler: str | None = None, event: str | None = None, element: str | None = None, command: str | None = None, limit: int = 50, kind: str = "handles-event") -> DataFrame:
    rows = t.edges.filter(F.col("kind_name") == kind).select("*", *[payload_value(k).alias(k) for k in ("event", "command")])
    for column, value in (("event", event), ("command", command)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    both = two_sided(t, rows)
    both = both if handler is None else both.filter(F.col("dst_key") == handler)
    both = both if element is None else both.filter(F.col("src_key") == element)
    return _page(both, limit).select("scope", "src_fqn", "dst_fqn", "event", "command", "src_path", "src_line")


def find_resource_references(t: GraphTables, key: str | None = None, limit: int = 50, kinds=("uses-resource", "applies-style")) -> DataFrame:
    rows = t.edges.filter(F.col("kind_name").isin(list(kinds))).withColumn("key", payload_value("key"))
    rows = rows if key is None else rows.filter(F.col("key") == key)
    return _page(two_sided(t, rows), limit).select("scope", "kind_name", "src_fqn", "dst_fqn", "key", "src_path", "src_line")


def has_payload_key(t: GraphTables, kind: str, key: str) -> bool:
    return not t.edges.filter((F.col("kind_name") == kind) & payload_value(key).isNotNull()).limit(1).isEmpty()


def payload_keys(t: GraphTables) -> DataFrame:
    """How many edges of each kind carry each payload key."""
    keys = F.explode(F.json_object_keys(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")))).alias("payload_key")
    return t.edges.select("kind_name", keys).groupBy("kind_name", "payload_key").agg(F.count("*").alias("n"))
