"""Path tracing: all simple paths of one relation, and paths that follow an ordered automaton."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.aggregate import hop_confidence
from codeloom.operators.lookup import located
from codeloom.operators.scoped import with_target_scope
from codeloom.operators.traversal import EDGE, auditable, nodes_of
from codeloom.session import cut
from codeloom.tables import GraphTables


@dataclass(frozen=True)
class Automaton:
    """transitions: (state, edge kind, next state)."""

    start: str
    terminal: str
    transitions: tuple[tuple[str, str, str], ...]

    @property
    def kinds(self) -> list[str]:
        return sorted({k for _, k, _ in self.transitions})


#: From a view's binding to a native algorithm (fixed value).
EXECUTION = Automaton("await-binding", "native-algorithm", (
    ("await-binding", "binds-path", "await-command"), ("await-command", "command-executes", "await-managed-call"), ("await-managed-call", "calls", "managed-client"),
    ("managed-client", "calls", "managed-client"), ("managed-client", "grpc-calls", "await-rpc-dispatch"), ("await-rpc-dispatch", "rpc-dispatches-to", "await-server-call"),
    ("await-server-call", "calls", "managed-server"), ("managed-server", "calls", "managed-server"), ("managed-server", "pinvoke-maps-to", "await-native-call"),
    ("await-native-call", "calls", "native-algorithm"), ("native-algorithm", "calls", "native-algorithm"),
))


def relation(kind: str) -> Automaton:
    """Any number of steps over one kind."""
    return Automaton("path", "path", (("path", kind, "path"),))


PATHS = "path_ids array<long>, path_scopes array<string>, kinds array<string>, confidence int, n_hops int, ends_at long"


@dataclass(frozen=True)
class Trace:
    """paths: path_ids, path_scopes, kinds, confidence, n_hops, ends_at.  ``truncated`` is set when the
    depth or a cap cut the walk, ``complete`` is what the caller knows of the facts: whether every
    projection that the walk needs had been published.  Only both together make the absence of a
    path a proof."""

    paths: DataFrame
    truncated: bool
    complete: bool = True

    @property
    def absence_authoritative(self) -> bool:
        return self.complete and not self.truncated


def _moves(t: GraphTables, automaton: Automaton) -> DataFrame:
    """The automaton as a table: a row per transition."""
    return F.broadcast(t.edges.sparkSession.createDataFrame(list(automaton.transitions), "state string, kind_name string, next_state string"))


def _steps(edges: DataFrame, frontier: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges that lead a state on to a node it hasn't visited."""
    near = frontier.withColumnRenamed("at_scope", "scope").withColumnRenamed("at", "src")
    to = F.struct(F.col("dst_scope").alias("scope"), F.col("dst").alias("id"))
    return edges.join(near, ["scope", "src"]).join(moves, ["state", "kind_name"]).withColumn("_to", to).filter(~F.array_contains("nodes", F.col("_to")))


def _start(sources: DataFrame, automaton: Automaton) -> DataFrame:
    node = F.struct("scope", "id")
    return sources.select(F.col("scope").alias("at_scope"), F.col("id").alias("at"), F.lit(automaton.start).alias("state"), F.array(node).alias("nodes"), F.array().cast("array<string>").alias("kinds")).distinct()


def trace_paths(t: GraphTables, sources: DataFrame, targets: DataFrame | None, automaton: Automaton, max_depth: int = 8, max_paths: int = 10, max_nodes: int = 1000, complete: bool = True) -> Trace:
    """All simple paths from the sources, breadth first, over auditable edges.

    A path stops at its first target.  Without targets it stops at a node in the terminal state that
    has no further auditable edge of the automaton.  States are expanded in the order of a queue
    (sources by id, edges by kind, path, line, column and id), ``max_nodes`` in all; every level is a
    join of a bounded frontier with the edges and a small table of transitions.  A state at
    ``max_depth`` that could go on makes the trace truncated.
    """
    if not (1 <= max_depth <= 12 and 1 <= max_paths <= 25_000 and 1 <= max_nodes <= 1_000_000):
        raise ValueError("bounds out of range")
    moves = _moves(t, automaton)
    place = located(t).select(F.col("scope").alias("dst_scope"), F.col("id").alias("dst"), "path", "start_line", "start_col")
    edges = cut(with_target_scope(t, auditable(t, automaton.kinds).select(*EDGE), "dst", "dst_scope").join(place, ["dst_scope", "dst"], "left"))
    order = ["kind_name", "path", "start_line", "start_col", "dst", "dst_scope"]
    starts = sources.select("scope", "id").distinct()
    if starts.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} sources")
    frontier = cut(_start(starts, automaton).withColumn("place", F.row_number().over(W.orderBy("at", "at_scope"))))
    end = ["at_scope", "at"]
    goal = None if targets is None else cut(targets.select(F.col("scope").alias("at_scope"), F.col("id").alias("at")).distinct())
    going_on = [k for s, k, _ in automaton.transitions if s == automaton.terminal]
    exits = edges.filter(F.col("kind_name").isin(going_on)).select(F.col("scope").alias("at_scope"), F.col("src").alias("at")).distinct()
    found: list[DataFrame] = []
    expanded, truncated = frontier.count(), False
    for depth in itertools.count(1):
        steps = _steps(edges, frontier.withColumnRenamed("place", "from_place"), moves)
        if depth > max_depth:
            truncated |= not steps.limit(1).isEmpty()
            break
        grown = steps.select(
            F.col("dst_scope").alias("at_scope"), F.col("dst").alias("at"), F.col("next_state").alias("state"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("kinds", F.array("kind_name")).alias("kinds"),
            "from_place", *[F.col(c).alias(f"o_{c}") for c in order],
        )
        room = max_nodes - expanded
        queue = ["from_place", *[f"o_{c}" for c in order]]
        level = cut(grown.orderBy(*queue).limit(room + 1).withColumn("place", F.row_number().over(W.orderBy(*queue))).drop(*queue))  # over at most ``max_nodes`` + 1 rows
        n = level.count()
        if n > room:
            truncated = True
            level = level.filter(F.col("place") <= room)
        if not min(n, room):
            break
        expanded += min(n, room)
        if goal is not None:
            found.append(level.join(goal, end, "left_semi"))
            frontier = level.join(goal, end, "left_anti")
        else:
            found.append(level.filter(F.col("state") == automaton.terminal).join(exits, end, "left_anti"))
            frontier = level
        if n > room:
            break
    if not found:
        return Trace(t.edges.sparkSession.createDataFrame([], PATHS), truncated, complete)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    rows = every.select("nodes", "kinds", F.size("kinds").alias("n_hops"), F.col("at").alias("ends_at"), "place")
    rows = cut(rows.dropDuplicates(["nodes", "kinds"]).orderBy("n_hops", "place").limit(max_paths + 1))
    if rows.count() > max_paths:
        truncated = True
        rows = cut(rows.orderBy("n_hops", "place").limit(max_paths))
    return Trace(_with_confidence(t, rows.drop("place")), truncated, complete)


def every_path(t: GraphTables, sources: DataFrame, automaton: Automaton, max_depth: int = 8) -> DataFrame:
    """All simple paths of an automaton from the sources to where it ends (a node in the terminal
    state without a further auditable edge of the automaton), without caps (columns as in
    ``Trace.paths``).  Each level is a join of two distributed sides and is written."""
    if max_depth < 1:
        raise ValueError("max_depth must be 1 at least")
    moves = _moves(t, automaton)
    hops = cut(with_target_scope(t, auditable(t, automaton.kinds).select("scope", "src", "dst", "kind_name").distinct(), "dst", "dst_scope"))
    going_on = [k for s, k, _ in automaton.transitions if s == automaton.terminal]
    exits = cut(hops.filter(F.col("kind_name").isin(going_on)).select(F.col("scope").alias("at_scope"), F.col("src").alias("at")).distinct())
    frontier, found = _start(sources, automaton), None
    for _ in range(max_depth):
        frontier = cut(_steps(hops, frontier, moves).select(
            F.col("dst_scope").alias("at_scope"), F.col("dst").alias("at"), F.col("next_state").alias("state"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("kinds", F.array("kind_name")).alias("kinds"),
        ))
        if frontier.isEmpty():
            break
        ended = frontier.filter(F.col("state") == automaton.terminal).join(exits, ["at_scope", "at"], "left_anti")
        found = ended if found is None else found.unionByName(ended)
    if found is None:
        return t.edges.sparkSession.createDataFrame([], PATHS)
    rows = found.select("nodes", "kinds", F.size("kinds").alias("n_hops"), F.col("at").alias("ends_at")).dropDuplicates(["nodes", "kinds"])
    return _with_confidence(t, cut(rows))


def paths_into(t: GraphTables, sources: DataFrame, targets: DataFrame, kind: str = "calls", max_depth: int = 8) -> DataFrame:
    """All simple paths of one relation from the sources to their first target, over auditable edges
    and without caps (columns as in ``Trace.paths``).

    Paths grow backwards from the targets, so steps that lead to no target are never walked and every
    symbol may be a source.  A path that has come to another target is kept, if that is a source, but
    grows no further.  Each level is a join of two distributed sides and is written.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be 1 at least")
    hops = cut(with_target_scope(t, auditable(t, [kind]).select("scope", "src", "dst").distinct(), "dst", "dst_scope").select("scope", "src", F.col("dst_scope").alias("at_scope"), F.col("dst").alias("at")))
    spot = ["at_scope", "at"]
    place = lambda rows: cut(rows.select(F.col("scope").alias("at_scope"), F.col("id").alias("at")).distinct())
    goal, begin = place(targets), place(sources)
    node = F.struct(F.col("at_scope").alias("scope"), F.col("at").alias("id"))
    frontier, found = goal.withColumn("nodes", F.array(node)), None
    for _ in range(max_depth):
        before = F.struct("scope", F.col("src").alias("id"))
        grown = hops.join(frontier, spot).withColumn("_from", before).filter(~F.array_contains("nodes", F.col("_from")))
        level = cut(grown.select(F.col("scope").alias("at_scope"), F.col("src").alias("at"), F.concat(F.array("_from"), "nodes").alias("nodes")))
        if level.isEmpty():
            break
        begun = level.join(begin, spot, "left_semi")
        found = begun if found is None else found.unionByName(begun)
        frontier = level.join(goal, spot, "left_anti")
    if found is None:
        return t.edges.sparkSession.createDataFrame([], PATHS)
    n_hops = F.size("nodes") - 1
    rows = found.select("nodes", F.array_repeat(F.lit(kind), n_hops).alias("kinds"), n_hops.alias("n_hops"), F.element_at("nodes", -1)["id"].alias("ends_at"))
    return _with_confidence(t, cut(rows))


def _with_confidence(t: GraphTables, paths: DataFrame) -> DataFrame:
    """Weakest hop of each path; proofs are read for the hops of the found paths only."""
    here, there = F.get("nodes", F.col("k")), F.get("nodes", F.col("k") + 1)
    hop = F.struct(here["scope"].alias("scope"), here["id"].alias("src"), there["id"].alias("dst"), F.get("kinds", F.col("k")).alias("kind_name"))
    hops = paths.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_hops") - 1))).select("nodes", "kinds", hop.alias("h")).select("nodes", "kinds", "h.*")
    proofs = t.edge_evidence.join(hops.select(*EDGE).distinct(), EDGE, "left_semi")
    strength = hop_confidence(t.with_tables(edge_evidence=proofs)).select(*EDGE, "confidence")
    weakest = hops.join(strength, EDGE).groupBy("nodes", "kinds").agg(F.min("confidence").alias("confidence"))
    return paths.join(weakest, ["nodes", "kinds"]).select(*nodes_of(), "kinds", "confidence", "n_hops", "ends_at")


#: Projections that a walk of the execution profile needs beside its scopes.
NEEDED = ("grpc", "native-interop")
#: Statuses of a scope whose facts are whole.
WHOLE = ("ok", "ready")


def projection_states(t: GraphTables, scopes: list[str], projections: DataFrame | None = None, execution: bool = False) -> DataFrame:
    """(scope, name, status, authoritative): what is known of the facts a walk reads.  projections: scope,
    name, status, retained_last_good, failures, a row per projection that has run.  A scope is
    authoritative if its status says so; a projection if it is complete, nothing older was retained
    and nothing failed; one that hasn't run is not."""
    spark = t.edges.sparkSession
    asked = spark.createDataFrame([(s,) for s in scopes], "scope string")
    status = t.scopes.select(F.col("id").alias("scope"), "status")
    own = asked.join(status, "scope", "left").select("scope", F.lit("scope").alias("name"), F.coalesce("status", F.lit("unknown")).alias("status"))
    own = own.withColumn("authoritative", F.col("status").isin(*WHOLE))
    if not execution:
        return own
    wanted = asked.withColumn("name", F.explode(F.array(*[F.lit(n) for n in NEEDED])))
    ran = projections if projections is not None else spark.createDataFrame([], "scope string, name string, status string, retained_last_good boolean, failures long")
    sure = (F.col("status") == "complete") & ~F.coalesce("retained_last_good", F.lit(False)) & (F.coalesce("failures", F.lit(0)) == 0)
    rest = wanted.join(ran, ["scope", "name"], "left").select("scope", "name", F.coalesce("status", F.lit("not-run")).alias("status"), F.coalesce(sure, F.lit(False)).alias("authoritative"))
    return own.unionByName(rest)


def is_complete(states: DataFrame) -> bool:
    """Whether there are states and all are authoritative."""
    n, sure = states.agg(F.count("*"), F.sum(F.col("authoritative").cast("long"))).first()
    return bool(n) and n == sure


def trace_stable(store, run) -> Trace:
    """Trace a snapshot (``run``: tables to a trace).  If another version was published meanwhile, the
    result stands for the version it read, and isn't complete."""
    version = store.current()
    done = run(store.read(version))
    return done if store.current() == version else Trace(done.paths, done.truncated, False)
