"""Ranked symbol lookup, members, references, diagnostics, annotations, history.

Every order ends in a unique key, so each limit keeps a determined set of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import accessibility_code, require_intent, severity_code
from codeloom.operators.scoped import pointing_at
from codeloom.tables import GraphTables


def located(t: GraphTables, symbols: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Symbols with their file's path."""
    symbols = t.symbols if symbols is None else symbols
    return symbols.join(t.files.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"], how)


def match_rank(text: str) -> Column:
    """0 canonical key, 1 full name, 2 name, 3 end of the full name, 4 start of the name, 5 inside
    the full name; null if none.  The last three ignore letter case and treat % and _ as wildcards."""
    return (
        F.when(F.col("canonical_key") == text, 0).when(F.col("fqn") == text, 1).when(F.col("name") == text, 2)
        .when(F.col("fqn").ilike(f"%.{text}"), 3).when(F.col("name").ilike(f"{text}%"), 4).when(F.col("fqn").ilike(f"%{text}%"), 5)
    )


def find_definition(t: GraphTables, symbol: str, file_hint: str | None = None, limit: int = 25) -> DataFrame:
    """Best matches by rank, length and spelling of the full name.  After the limit, exact keys (or,
    without any, exact full names) push out all weaker matches."""
    rows = located(t).withColumn("rank", match_rank(symbol)).filter("rank is not null")
    if require_intent(symbol):
        rows = rows.filter("rank = 0")
    if file_hint:
        rows = rows.filter(F.col("path").ilike(f"%{file_hint}%"))
    top = rows.orderBy("rank", F.length("fqn"), "fqn", "scope", "id").limit(limit)
    best = F.min("rank").over(W.partitionBy(F.lit(0)))  # over at most ``limit`` rows
    narrowed = top.withColumn("best", best).filter((F.col("best") > 1) | (F.col("rank") == F.col("best")))
    return narrowed.select("scope", "id", "canonical_key", "name", "fqn", "kind_name", "path", "start_line", "rank")


def top_match(t: GraphTables, symbol: str) -> DataFrame:
    """The single best match (scope, id), or no row."""
    return find_definition(t, symbol).orderBy("rank", F.length("fqn"), "fqn", "scope", "id").limit(1).select("scope", "id")


def get_symbol(t: GraphTables, canonical_key: str | None = None, symbol_id: int | None = None) -> DataFrame:
    rows = located(t, how="left")
    rows = rows.filter(F.col("canonical_key") == canonical_key) if canonical_key is not None else rows
    return rows.filter(F.col("id") == symbol_id) if symbol_id is not None else rows


def list_symbols_in_file(t: GraphTables, path: str) -> DataFrame:
    rows = located(t).filter((F.col("path") == path) | F.col("path").ilike(f"%{path}"))
    return rows.select("scope", "path", "id", "name", "fqn", "kind_name", "start_line", "start_col").orderBy("path", "start_line", "start_col", "id")


def list_members(t: GraphTables, container: DataFrame, accessibility: str | None = None, limit: int = 100) -> DataFrame:
    """Direct children of the containers (scope, id)."""
    rows = t.symbols.join(container.select("scope", F.col("id").alias("container_id")), ["scope", "container_id"], "left_semi")
    code = accessibility_code(accessibility)
    rows = rows if code is None else rows.filter(F.col("accessibility") == code)
    return rows.select("scope", "id", "name", "kind_name", "accessibility", "start_line", "container_id").orderBy("start_line", "name", "id").limit(limit)


def find_references(t: GraphTables, target: DataFrame, include_generated: bool = False, limit: int = 50) -> DataFrame:
    """References to the targets (scope, id); a shared symbol is referred to from any scope."""
    files = t.files if include_generated else t.files.filter("is_generated = 0")
    rows = pointing_at(t, t.refs, "symbol_id", target).join(files.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"])
    return rows.select("scope", "id", "symbol_id", "path", "line", "col", "kind").orderBy("path", "line", "col", "id", "scope").limit(limit)


def find_diagnostics(t: GraphTables, severity: str | None = "warning", code: str | None = None, symbol: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Findings of at least a severity, with their symbol if they have one."""
    rows = t.diagnostics.filter(F.col("severity") >= severity_code(severity))
    if code is not None:
        rows = rows.filter(F.col("code") == code)
    if symbol is not None:
        rows = rows.join(symbol.select("scope", F.col("id").alias("symbol_id")), ["scope", "symbol_id"], "left_semi")
    files = t.files.select("scope", F.col("id").alias("file_id"), "path")
    names = t.symbols.select("scope", F.col("id").alias("symbol_id"), "fqn")
    rows = rows.join(files, ["scope", "file_id"]).join(names, ["scope", "symbol_id"], "left")
    return rows.select("scope", "id", "symbol_id", "fqn", "severity", "code", "message", "path", "line", "col").orderBy("path", "line", "col", "id").limit(limit)


def diagnostic_files(t: GraphTables, codes) -> DataFrame:
    return t.diagnostics.filter(F.col("code").isin(list(codes))).select("scope", "file_id").distinct()


def cleaned_arguments(column: str = "args_json") -> Column:
    """Arguments without JSON punctuation, as they are searched."""
    return F.translate(F.col(column), '{}[]":,\\', "        ")


def find_by_annotation(t: GraphTables, name: str, flavor: str | None = None, argument: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """One row per annotated symbol.  An argument of fewer than three characters is ignored."""
    rows = t.annotations.filter(F.col("name") == name)
    rows = rows if flavor is None else rows.filter(F.col("flavor") == flavor)
    if argument is not None and len(argument.strip()) >= 3:
        rows = rows.filter(F.contains(F.lower(cleaned_arguments()), F.lit(argument.strip().lower())))
    hits = rows.select("scope", F.col("symbol_id").alias("id")).distinct()
    symbols = t.symbols if kind is None else t.symbols.filter(F.col("kind_name") == kind)
    found = located(t, symbols.join(hits, ["scope", "id"], "left_semi"))
    return found.select("scope", "id", "fqn", "kind_name", "path", "start_line").orderBy("path", "start_line", "id").limit(limit)


def annotations_of(t: GraphTables, symbol: DataFrame) -> DataFrame:
    one = symbol.select("scope", F.col("id").alias("symbol_id"))
    return t.annotations.join(one, ["scope", "symbol_id"], "left_semi").orderBy("id")


def annotations_page(t: GraphTables, flavor: str, after_id: int = 0, limit: int = 1000) -> DataFrame:
    """Keyset page: the next ids after the last one seen."""
    return t.annotations.filter((F.col("flavor") == flavor) & (F.col("id") > after_id)).orderBy("id").limit(min(limit, 1000))


def annotations_in_files(t: GraphTables, files: DataFrame, flavors) -> DataFrame:
    """Annotations of listed flavors on symbols of the listed files (scope, file_id)."""
    inside = t.symbols.join(files.select("scope", "file_id").distinct(), ["scope", "file_id"], "left_semi").select("scope", F.col("id").alias("symbol_id"), "file_id")
    return t.annotations.filter(F.col("flavor").isin(list(flavors))).join(inside, ["scope", "symbol_id"])


def list_generated_files(t: GraphTables, limit: int = 100) -> DataFrame:
    counts = t.symbols.groupBy("scope", "file_id").agg(F.count("*").alias("n"))
    files = t.files.filter("is_generated = 1").select("scope", F.col("id").alias("file_id"), "path")
    rows = files.join(counts, ["scope", "file_id"], "left").withColumn("n_symbols", F.coalesce("n", F.lit(0)))
    return rows.select("scope", "file_id", "path", "n_symbols").orderBy(F.desc("n_symbols"), "path", "file_id").limit(limit)


def outgoing_state(t: GraphTables) -> DataFrame:
    """Per file: is it generated, and does it hold references or the source of an edge."""
    holders = t.refs.select("scope", "file_id").union(
        t.symbols.join(t.edges.select("scope", F.col("src").alias("id")), ["scope", "id"], "left_semi").select("scope", "file_id")
    ).distinct().withColumn("has_outgoing", F.lit(True))
    files = t.files.select("scope", F.col("id").alias("file_id"), "is_generated")
    return files.join(holders, ["scope", "file_id"], "left").select("scope", "file_id", (F.col("is_generated") == 1).alias("is_generated"), F.coalesce("has_outgoing", F.lit(False)).alias("has_outgoing"))


def list_tests_for(t: GraphTables, symbol: DataFrame, indirect: bool = False, limit: int = 50) -> DataFrame:
    """Sources of ``tests`` edges into the symbol; with ``indirect``, also tests that call it."""
    kinds = ["tests", "calls"] if indirect else ["tests"]
    sources = pointing_at(t, t.edges.filter(F.col("kind_name").isin(kinds)), "dst", symbol).select("scope", F.col("src").alias("id"), (F.col("kind_name") == "tests").alias("direct"))
    sources = sources.groupBy("scope", "id").agg(F.max("direct").alias("direct"))
    rows = located(t).join(sources, ["scope", "id"]).filter("direct or test_framework is not null")
    return rows.select("scope", "id", "fqn", "test_framework", "direct", "path", "start_line").orderBy("path", "start_line", "id").limit(limit)


def who_authored(t: GraphTables, symbol: DataFrame) -> DataFrame:
    one = symbol.select("scope", F.col("id").alias("symbol_id"))
    return t.symbol_history.join(one, ["scope", "symbol_id"], "left_semi").select("scope", "symbol_id", "last_commit_sha", "last_author", "last_authored_at", "line_count")


def recent_changes(t: GraphTables, now_ms: int, days: int = 7, author: str | None = None, limit: int = 50) -> DataFrame:
    """Changes of the last days before an explicit time, newest first."""
    rows = t.symbol_history.filter(F.col("last_authored_at") >= now_ms - days * 86_400_000)
    rows = rows if author is None else rows.filter(F.contains(F.lower("last_author"), F.lit(author.lower())))
    names = located(t).select("scope", F.col("id").alias("symbol_id"), "fqn", "path")
    joined = rows.join(names, ["scope", "symbol_id"])
    return joined.select("scope", "symbol_id", "fqn", "path", "last_author", "last_authored_at").orderBy(F.desc("last_authored_at"), "fqn", "symbol_id").limit(limit)


def history_of(t: GraphTables, ids: DataFrame) -> DataFrame:
    """History of many symbols (scope, symbol_id); symbols without any keep nulls."""
    return ids.join(t.symbol_history.select("scope", "symbol_id", "last_author", "last_authored_at"), ["scope", "symbol_id"], "left")


def edge_evidence(t: GraphTables, edges: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` pieces of evidence of each edge (scope, src, dst, kind_name)."""
    keys = ["scope", "src", "dst", "kind_name"]
    order = W.partitionBy(*keys).orderBy("file_path", "start_line", "start_col", "id")
    rows = t.edge_evidence.join(edges.select(*keys).distinct(), keys, "left_semi")
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= min(most, 1000))


def has_evidence_by(t: GraphTables, producer: str) -> bool:
    return not t.edge_evidence.filter(F.col("producer") == producer).limit(1).isEmpty()


def sample_files(t: GraphTables, n: int = 20, seed: int = 0) -> DataFrame:
    """A sample of files for a drift check, the same for a seed whatever the partitioning."""
    return t.files.orderBy(F.xxhash64("scope", "id", F.lit(seed)), "scope", "id").limit(n)


def symbol_card(t: GraphTables, canonical_key: str) -> DataFrame:
    """One symbol with its numbers of callers, callees, references and members."""
    one = get_symbol(t, canonical_key=canonical_key).select("scope", "id", "canonical_key", "fqn", "kind_name", "signature", "path", "start_line")
    few = one.select("scope", "id")
    inside = lambda rows, key: rows.join(few.withColumnRenamed("id", key), ["scope", key], "left_semi").select(F.col("scope").alias("_to"), key)
    from_all = lambda rows, key: pointing_at(t, rows, key, few, "_to").select("_to", key)
    calls = t.edges.filter("kind_name = 'calls'")
    out = one
    for rows, key, name in ((from_all(calls, "dst"), "dst", "n_callers"), (inside(calls, "src"), "src", "n_callees"), (from_all(t.refs, "symbol_id"), "symbol_id", "n_references"), (inside(t.symbols, "container_id"), "container_id", "n_members")):
        out = out.join(rows.groupBy(F.col("_to").alias("scope"), F.col(key).alias("id")).agg(F.count("*").alias(name)), ["scope", "id"], "left")
    return out.fillna(0, ["n_callers", "n_callees", "n_references", "n_members"])
