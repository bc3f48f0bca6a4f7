"""Summaries, counts, vocabularies, confidence algebra, blame roll-up, usage, paging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.scoped import with_target_scope
from codeloom.tables import SCHEMAS, GraphTables

#: Evidence rows of a hop that count for its confidence (fixed value).
HOP_EVIDENCE = 21
#: Salts that a large scope's rows are ranked in first.
SALTS = 64


def in_degrees(t: GraphTables, kind: str = "calls") -> DataFrame:
    """(scope, dst, in_degree): distinct callers per symbol (a shared one's from all scopes); edges are
    distinct already, so partial counts are combined before the shuffle and a hot symbol costs one
    row per task."""
    per = t.edges.filter(F.col("kind_name") == kind).groupBy("scope", "dst").agg(F.count("*").alias("n"))
    meant = with_target_scope(t, per, "dst", "_to")
    return meant.groupBy(F.col("_to").alias("scope"), "dst").agg(F.sum("n").alias("in_degree"))


def module_summary(t: GraphTables, prefix: str, top_k: int = 25) -> DataFrame:
    """Symbols of a namespace or path, the most called first."""
    rows = t.symbols.join(t.files.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"])
    rows = rows.filter((F.col("fqn") == prefix) | F.col("fqn").ilike(f"{prefix}.%") | F.contains(F.col("path"), F.lit(prefix)))
    ranked = rows.join(in_degrees(t).withColumnRenamed("dst", "id"), ["scope", "id"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return ranked.select("scope", "id", "fqn", "kind_name", "path", "in_degree").orderBy(F.desc("in_degree"), F.length("fqn"), "fqn", "id", "scope").limit(top_k)


def row_counts(t: GraphTables, names=None) -> DataFrame:
    """Rows per table."""
    parts = [getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in (names or SCHEMAS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def vocabularies(t: GraphTables) -> DataFrame:
    """Distinct kinds of edges, symbols and annotations, with counts."""
    part = lambda rows, column, name: rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("vocabulary"), "value", "n")
    return part(t.edges, "kind_name", "edge-kind").union(part(t.symbols, "kind_name", "symbol-kind")).union(part(t.annotations, "flavor", "annotation-flavor"))


def scope_vocabulary(t: GraphTables, known=()) -> DataFrame:
    """Edge kinds per scope and in total ('*'), united with the known ones."""
    stored = t.edges.groupBy("scope", F.col("kind_name").alias("value")).agg(F.count("*").alias("n"))
    total = stored.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit("*").alias("scope"), "value", "n")
    every = stored.union(total)
    if known:
        floor = t.edges.sparkSession.createDataFrame([("*", k, 0) for k in known], "scope string, value string, n long")
        every = every.union(floor)
    return every.groupBy("scope", "value").agg(F.sum("n").alias("n"))


def hop_confidence(t: GraphTables) -> DataFrame:
    """Strongest confidence among the first pieces of evidence of each edge."""
    keys = ["scope", "src", "dst", "kind_name"]
    order = W.partitionBy(*keys).orderBy("file_path", "start_line", "start_col", "id")
    few = t.edge_evidence.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= HOP_EVIDENCE)
    return few.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min("confidence").alias("weakest"), F.count("*").alias("n_evidence"))


def path_confidence(hops: str = "hops") -> Column:
    """Weakest hop of a path."""
    return F.array_min(F.transform(hops, lambda h: h["confidence"]))


def first_evidence(t: GraphTables) -> DataFrame:
    """Payload of each edge's first evidence ('' as null), the logical edge's payload."""
    keys = ["scope", "src", "dst", "kind_name"]
    return t.edge_evidence.groupBy(*keys).agg(F.nullif(F.min_by("payload", "id"), F.lit("")).alias("payload"), F.min("id").alias("evidence_id"))


def overall_status(rows: DataFrame, by, status: str = "status") -> DataFrame:
    """One status if all agree, 'matched' if they differ, 'not-found' if there is none."""
    seen = F.collect_set(status)  # distinct statuses: a handful
    return rows.groupBy(*by).agg(F.when(F.size(seen) == 0, "not-found").when(F.size(seen) == 1, F.array_max(seen)).otherwise("matched").alias("status"))


def blame_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Latest blame line inside each symbol's span.

    spans: scope, symbol_id, file_id, start_line, end_line.  lines: scope, file_id, line, sha,
    author, authored_at.  Spans are clamped to the file; of equal times the first line wins; a span
    without lines gives no row.  The range join is cut into blocks of lines, so one large file is
    no single task.
    """
    block = 256
    last = lines.groupBy("scope", "file_id").agg(F.max("line").alias("last_line"))
    inside = spans.join(last, ["scope", "file_id"]).withColumn("end_line", F.least("end_line", "last_line")).filter("start_line <= end_line")
    pieces = inside.withColumn("block", F.explode(F.sequence((F.col("start_line") / block).cast("int"), (F.col("end_line") / block).cast("int"))))
    hit = pieces.join(lines.withColumn("block", (F.col("line") / block).cast("int")), ["scope", "file_id", "block"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    newest = F.max_by(F.struct("sha", "author", "authored_at"), F.struct("authored_at", -F.col("line")))
    rows = hit.groupBy("scope", "symbol_id", "start_line", "end_line").agg(newest.alias("r"))
    return rows.select("scope", "symbol_id", F.col("r.sha").alias("last_commit_sha"), F.col("r.author").alias("last_author"), F.col("r.authored_at").alias("last_authored_at"), (F.col("end_line") - F.col("start_line") + 1).alias("line_count"))


def usage_stats(calls: DataFrame) -> DataFrame:
    """Per tool: calls, errors, mean and longest time, mean size (rows: tool, ms, ok, bytes)."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("n_calls"), F.sum((~F.col("ok")).cast("long")).alias("n_errors"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("bytes"), 3).alias("avg_bytes")
    )


def first_page(rows: DataFrame, order, limit: int) -> tuple[DataFrame, bool]:
    """The first rows and whether there are more (one row more is asked for)."""
    more = rows.orderBy(*order).limit(limit + 1)
    return rows.orderBy(*order).limit(limit), more.count() > limit


def budget_rows(row_chars: int, budget: int = 50_000, reserve: int = 2_000) -> int:
    """Rows that fit into an output budget."""
    return max(1, (budget - reserve) // row_chars)


def fair_share(rows: DataFrame, order, limit: int, scopes: int) -> DataFrame:
    """At most limit rows, shared evenly among scopes (in their order, the first get the rest)."""
    base, rest = divmod(limit, max(1, scopes))
    # no share is larger than base + 1, so a scope's rows are ranked in salts first and few of them together
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("scope", "_salt").orderBy(*order))).filter(F.col("_nth") <= base + 1).drop("_salt", "_nth")
    nth = F.row_number().over(W.partitionBy("scope").orderBy(*order))
    names = rows.select("scope").distinct().withColumn("scope_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("scope")))
    share = F.lit(base) + (F.col("scope_no") <= rest).cast("int")
    return rows.withColumn("nth", nth).join(names, "scope").filter(F.col("nth") <= share).drop("scope_no")
