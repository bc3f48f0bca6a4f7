"""Curated views over the model, with the catalog of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.tables import GraphTables

VIEW_VERSION = 3
TYPE_KINDS = ("class", "struct", "interface", "enum", "record", "delegate")
PUBLIC = 6
CONFIDENCE = {0: "inferred", 1: "semantic", 2: "exact"}
REFERENCE_KIND = {0: "def", 1: "ref", 2: "call", 3: "impl", 4: "inherit", 5: "read", 6: "write"}
SEVERITY = {0: "hidden", 1: "info", 2: "warning", 3: "error"}


def named(column: str, names: dict[int, str]) -> Column:
    """A code's name; unknown codes as text."""
    value = F.col(column)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for code, name in names.items():
        out = out.when(value == code, F.lit(name))
    return out.otherwise(value.cast("string"))


def v_symbols(t: GraphTables) -> DataFrame:
    return t.symbols.select(
        "scope", "id", "canonical_key", "name", "fqn", F.col("kind_name").alias("kind"), "file_id", "start_line", "start_col", "end_line", "end_col", "signature", "container_id", "modifiers", "accessibility", "xml_summary", "test_framework",
        F.when(F.col("accessibility") == PUBLIC, 1).otherwise(0).alias("is_public"), F.when(F.col("kind_name").isin(*TYPE_KINDS), 1).otherwise(0).alias("is_type"),
    )


def v_files(t: GraphTables) -> DataFrame:
    return t.files.select("scope", "id", "path", F.col("content_sha256").alias("sha256"), "last_indexed_at", "is_generated")


def v_edges(t: GraphTables) -> DataFrame:
    return t.edges.select("scope", "src", "dst", F.col("kind_name").alias("kind"), "payload")


def v_edge_evidence(t: GraphTables) -> DataFrame:
    return t.edge_evidence.select(
        "scope", "id", "src", "dst", F.col("kind_name").alias("kind"), "producing_file_id", "file_path", "start_line", "start_col", "end_line", "end_col", named("confidence", CONFIDENCE).alias("confidence"), "producer", F.nullif(F.col("payload"), F.lit("")).alias("payload")
    )


def v_references(t: GraphTables) -> DataFrame:
    return t.refs.select("scope", "id", "symbol_id", "file_id", "line", "col", named("kind", REFERENCE_KIND).alias("kind"))


def v_scopes(t: GraphTables) -> DataFrame:
    return t.scopes.select("id", "name", "root", "isolated", "last_indexed_at", "status", "status_message")


def v_annotations(t: GraphTables) -> DataFrame:
    return t.annotations.select("scope", "id", "symbol_id", "name", "full_name", "flavor", "args_json", "attribute_symbol_id")


def v_diagnostics(t: GraphTables) -> DataFrame:
    return t.diagnostics.select("scope", "id", "symbol_id", "file_id", named("severity", SEVERITY).alias("severity"), "code", "message", "line", "col")


def v_history(t: GraphTables) -> DataFrame:
    return t.symbol_history.select("scope", "symbol_id", "last_commit_sha", "last_author", "last_authored_at", "line_count")


VIEWS = {
    "v_symbols": (v_symbols, "Declared symbols"), "v_files": (v_files, "Indexed files"), "v_edges": (v_edges, "Logical edges"), "v_edge_evidence": (v_edge_evidence, "Occurrences that prove an edge"),
    "v_references": (v_references, "Places that mention a symbol"), "v_scopes": (v_scopes, "Registered scopes"), "v_annotations": (v_annotations, "Attributes and derived facts"),
    "v_diagnostics": (v_diagnostics, "Compiler and rule findings"), "v_history": (v_history, "Last change of each symbol"),
}


def register_views(spark: SparkSession, t: GraphTables, prefix: str = "") -> None:
    for name, (build, _) in VIEWS.items():
        build(t).createOrReplaceTempView(prefix + name)


def catalog(t: GraphTables) -> DataFrame:
    """(view_name, column_name, type, nullable, position, doc) of every view."""
    spark = t.files.sparkSession
    rows = [(n, f.name, f.dataType.simpleString(), True, k, doc) for n, (build, doc) in VIEWS.items() for k, f in enumerate(build(t).schema)]
    return spark.createDataFrame(rows, "view_name string, column_name string, type string, nullable boolean, position int, doc string")
