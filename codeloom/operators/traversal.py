"""Walks over edges: callers, callees, neighbourhoods, and breadth-first impact.

A node is a symbol of a scope (scope, id).  The source of an edge is in the edge's scope, its target
there or among the shared symbols (see ``scoped``).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.aggregate import HOP_EVIDENCE, hop_confidence
from codeloom.operators.lookup import located
from codeloom.operators.scoped import pointing_at, with_target_scope
from codeloom.session import cut
from codeloom.tables import GraphTables

EDGE = ["scope", "src", "dst", "kind_name"]
#: Symbols that one impact walk starts from at most; more are an error.
FRONTIER = 5_000
#: Kinds that one question may name, and rows it may ask for.
MOST_KINDS, MOST_ROWS = 32, 1_024


def auditable(t: GraphTables, kinds=None) -> DataFrame:
    """Edges that have evidence, filtered before any cap is applied."""
    edges = t.edges if kinds is None else t.edges.filter(F.col("kind_name").isin(list(kinds)))
    return edges.join(t.edge_evidence.select(*EDGE).distinct(), EDGE, "left_semi")


def _step(t: GraphTables, edges: DataFrame, nodes: DataFrame, inbound: bool) -> DataFrame:
    """Edges at the nodes (scope, id) with the symbol on the other side, if it has a file."""
    far = "src" if inbound else "dst"
    other = located(t).select("scope", F.col("id").alias(far), "fqn", F.col("kind_name").alias("symbol_kind"), "path", "start_line", "start_col")
    if inbound:
        near = pointing_at(t, edges, "dst", nodes)
    else:
        near = edges.join(nodes.select("scope", F.col("id").alias("src")).distinct(), ["scope", "src"], "left_semi")
    return near.join(other, ["scope", far])


def adjacent(t: GraphTables, nodes: DataFrame, kind: str | None = None, inbound: bool = True, evidence: bool = False, limit: int = 50) -> DataFrame:
    """Callers (inbound) or callees of the nodes, by path and line; ``evidence`` keeps only edges
    that have some."""
    return adjacent_by_kinds(t, nodes, None if kind is None else [kind], inbound, evidence, limit)


def adjacent_by_kinds(t: GraphTables, nodes: DataFrame, kinds: list[str] | None, inbound: bool = False, evidence: bool = True, limit: int = MOST_ROWS) -> DataFrame:
    """As ``adjacent``, for 1 to 32 kinds and up to 1024 rows (one more tells that there are more)."""
    if kinds is not None and not 1 <= len(set(kinds)) <= MOST_KINDS:
        raise ValueError(f"name 1 to {MOST_KINDS} kinds")
    if not 1 <= limit <= MOST_ROWS + 1:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    edges = auditable(t, kinds) if evidence else (t.edges if kinds is None else t.edges.filter(F.col("kind_name").isin(list(kinds))))
    rows = _step(t, edges, nodes, inbound)
    return rows.select(*EDGE, "fqn", "symbol_kind", "path", "start_line").orderBy("kind_name", "path", "start_line", "src", "dst", "scope").limit(limit)


def list_calls(t: GraphTables, nodes: DataFrame, kind: str | None = "calls", inbound: bool = True, limit: int = 50, most: int = 20) -> DataFrame:
    """Auditable callers or callees, each with its first pieces of evidence, its confidence, and whether
    there is more evidence (``truncated_evidence``)."""
    rows = adjacent(t, nodes, kind, inbound, True, limit)
    order = W.partitionBy(*EDGE).orderBy("file_path", "start_line", "start_col", "id")
    proofs = t.edge_evidence.join(rows.select(*EDGE), EDGE, "left_semi").withColumn("nth", F.row_number().over(order))
    proofs = proofs.filter(F.col("nth") <= max(most + 1, HOP_EVIDENCE))
    shown = F.col("nth") <= most
    lists = proofs.groupBy(*EDGE).agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("nth", "file_path", F.col("start_line").alias("line"), "confidence", "producer")))).alias("evidence"),
        F.max(F.when(F.col("nth") <= HOP_EVIDENCE, F.col("confidence"))).alias("confidence"), (F.max("nth") > most).alias("truncated_evidence"),
    )
    return rows.join(lists, EDGE)


def find_implementations(t: GraphTables, nodes: DataFrame, kind: str = "implements-member", include_abstract: bool = False, limit: int = 50) -> DataFrame:
    """Inbound edges of a kind; abstract ones are dropped after the limit, as the limit counts them."""
    rows = adjacent(t, nodes, kind, True, False, limit)
    if include_abstract:
        return rows
    signatures = t.symbols.select("scope", F.col("id").alias("src"), "signature")
    return rows.join(signatures, ["scope", "src"], "left").filter(~F.contains(F.coalesce("signature", F.lit("")), F.lit("abstract"))).select(*rows.columns)


def neighborhood(t: GraphTables, nodes: DataFrame, kind: str | None = None, per_category: int = 20) -> DataFrame:
    callers = adjacent(t, nodes, kind, True, False, per_category).withColumn("direction", F.lit("in"))
    return callers.unionByName(adjacent(t, nodes, kind, False, False, per_category).withColumn("direction", F.lit("out")))


def links_of(t: GraphTables, edges: DataFrame) -> DataFrame:
    """Distinct (scope, src, dst_scope, dst) of edges."""
    return with_target_scope(t, edges.select("scope", "src", "dst").distinct(), "dst", "dst_scope")


def impact_levels(t: GraphTables, nodes: DataFrame, kind: str | None = "calls", max_depth: int = 4, evidence: bool = False) -> DataFrame:
    """(scope, id, depth): every symbol upstream of the nodes at its least depth; a node itself comes
    out only if a circle leads back to it.  One join per level against the edges; each level is
    written, so the plan doesn't grow."""
    edges = auditable(t, None if kind is None else [kind]) if evidence else (t.edges if kind is None else t.edges.filter(F.col("kind_name") == kind))
    links = cut(links_of(t, edges))
    node = ["scope", "id"]
    frontier = nodes.select(F.col("scope").alias("dst_scope"), F.col("id").alias("dst")).distinct()
    seen = None
    for depth in range(1, max_depth + 1):
        reached = links.join(frontier, ["dst_scope", "dst"], "left_semi").select("scope", F.col("src").alias("id")).distinct()
        if seen is not None:
            reached = reached.join(seen, node, "left_anti")
        reached = cut(reached.withColumn("depth", F.lit(depth)))
        if reached.isEmpty():
            break
        seen = reached if seen is None else seen.unionByName(reached)
        frontier = reached.select(F.col("scope").alias("dst_scope"), F.col("id").alias("dst"))
    return seen if seen is not None else nodes.select("scope", "id", F.lit(0).alias("depth")).limit(0)


@dataclass(frozen=True)
class Impact:
    """rows of ``impact``; ``truncated`` is set where the depth, the limit or a symbol's branch limit
    left something out."""

    rows: DataFrame
    truncated: bool


def nodes_of(ids: str = "nodes") -> list[Column]:
    return [F.transform(ids, lambda n: n["id"]).alias("path_ids"), F.transform(ids, lambda n: n["scope"]).alias("path_scopes")]


def _branches(edges: DataFrame, near: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` edges of each frontier node.  Spark keeps no more than ``most`` rows of a node per
    task before it shuffles them (up to 1,000), so a hot node is no large group."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return edges.join(near, keys).withColumn("branch", rank).filter(F.col("branch") <= most)


def impact(t: GraphTables, nodes: DataFrame, kind: str | None = "calls", max_depth: int = 4, limit: int = 100) -> Impact:
    """Breadth-first impact over auditable edges: each symbol once, with depth, predecessor, path
    from the changed symbol and the path's confidence.

    The order of discovery is that of a queue: by the predecessor's place, then kind, path, line,
    column and id of the caller; each predecessor hands on ``limit`` + 1 callers at most, and the
    result has ``limit`` rows, so the frontier is bounded.
    """
    if not (1 <= max_depth <= 12 and 1 <= limit <= 1000):
        raise ValueError("max_depth must be 1 to 12, limit 1 to 1000")
    order = ["kind_name", "path", "start_line", "start_col", "src", "scope"]
    place = located(t).select("scope", F.col("id").alias("src"), "path", "start_line", "start_col")
    edges = cut(with_target_scope(t, auditable(t, None if kind is None else [kind]).select(*EDGE).join(place, ["scope", "src"]), "dst", "dst_scope"))
    start = nodes.select("scope", "id").distinct().limit(FRONTIER + 1)
    node = F.struct("scope", "id")
    frontier = cut(start.select("scope", "id", F.lit(0).alias("depth"), F.row_number().over(W.orderBy("id", "scope")).alias("place"), F.lit(None).cast("long").alias("predecessor"), F.array(node).alias("nodes"), F.array().cast("array<string>").alias("kinds")))
    if frontier.count() > FRONTIER:
        raise ValueError(f"more than {FRONTIER} symbols to start from")
    done, left, truncated = frontier, limit, False
    for depth in itertools.count(1):
        # the frontier has at most FRONTIER or ``limit`` rows
        near = F.broadcast(frontier.select(F.col("scope").alias("dst_scope"), F.col("id").alias("dst"), F.col("place").alias("from_place"), "nodes", "kinds"))
        steps = cut(_branches(edges, near, ["dst_scope", "dst"], order, limit + 1))  # a frontier's few rows times the limit
        fresh = steps.join(F.broadcast(done.select("scope", F.col("id").alias("src"))), ["scope", "src"], "left_anti")
        if depth > max_depth:
            truncated |= not fresh.limit(1).isEmpty()
            break
        first = fresh.withColumn("nth", F.row_number().over(W.partitionBy("scope", "src").orderBy("from_place", *order))).filter("nth = 1").orderBy("from_place", *order).limit(left + 1)
        numbered = first.withColumn("place", F.row_number().over(W.orderBy("from_place", *order)))  # over at most ``limit`` + 1 rows
        walked = F.concat("nodes", F.array(F.struct("scope", F.col("src").alias("id"))))
        level = cut(numbered.coalesce(1).select("scope", F.col("src").alias("id"), F.lit(depth).alias("depth"), "place", F.col("dst").alias("predecessor"), walked.alias("nodes"), F.concat("kinds", F.array("kind_name")).alias("kinds")))
        n = level.count()
        truncated = truncated or n > left or not steps.filter(F.col("branch") > limit).limit(1).isEmpty()
        if not n:
            break
        frontier = level.filter(F.col("place") <= left)
        done = done.unionByName(frontier)
        left -= min(n, left)
        if truncated and not left:
            break
    found = done.filter("depth > 0").drop("place")
    # a hop leads from the later to the earlier symbol of the path; proofs are read for these hops only
    later, earlier = F.get("nodes", F.col("k") + 1), F.get("nodes", F.col("k"))
    hop = F.struct(later["scope"].alias("scope"), later["id"].alias("src"), earlier["id"].alias("dst"), F.get("kinds", F.col("k")).alias("kind_name"))
    hops = found.select(F.struct("scope", "id").alias("_node"), F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("k"), "nodes", "kinds").select("_node", hop.alias("h")).select("_node", "h.*")
    proofs = t.edge_evidence.join(hops.select(*EDGE).distinct(), EDGE, "left_semi")
    strength = hop_confidence(t.with_tables(edge_evidence=proofs)).select(*EDGE, "confidence")
    weakest = hops.join(strength, EDGE).groupBy("_node").agg(F.min("confidence").alias("confidence")).select("_node.*", "confidence")
    names = t.symbols.select("scope", "id", "fqn", "kind_name")
    rows = found.join(weakest, ["scope", "id"]).join(names, ["scope", "id"])
    return Impact(rows.select("scope", "id", "fqn", "kind_name", "depth", "predecessor", *nodes_of(), "confidence"), truncated)


def impact_of_change(t: GraphTables, nodes: DataFrame, kind: str | None = "calls", max_depth: int = 4, limit: int = 100) -> DataFrame:
    """The rows of ``impact``."""
    return impact(t, nodes, kind, max_depth, limit).rows


def ancestors_by_relation(t: GraphTables, kind: str = "inherits", max_depth: int | None = None) -> DataFrame:
    """(scope, id, base_scope, base, depth): the closure of a relation such as inheritance, level by
    level until a level has nothing new; pairs that are known already aren't walked again, so circles
    end."""
    links = cut(links_of(t, t.edges.filter(F.col("kind_name") == kind)).select("scope", F.col("src").alias("id"), F.col("dst_scope").alias("base_scope"), F.col("dst").alias("base")))
    pair = ["scope", "id", "base_scope", "base"]
    frontier = seen = cut(links.withColumn("depth", F.lit(1)))
    via = links.select(F.col("scope").alias("via_scope"), F.col("id").alias("via"), "base_scope", "base")
    for depth in itertools.count(2):
        if max_depth is not None and depth > max_depth:
            return seen
        step = frontier.select("scope", "id", F.col("base_scope").alias("via_scope"), F.col("base").alias("via")).join(via, ["via_scope", "via"]).select(*pair).distinct()
        frontier = cut(step.join(seen.select(*pair), pair, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
