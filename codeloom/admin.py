"""Scopes, health, drift and repair, usage log, result tables, and hooks for own code."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.aggregate import row_counts
from codeloom.operators.lookup import sample_files
from codeloom.operators.merge import SnapshotStore, delete_files, drift, integrity
from codeloom.operators.scoped import resolvable
from codeloom.session import cut
from codeloom.tables import SCHEMAS, GraphTables

USAGE = "tool string, ms double, ok boolean, bytes long, at timestamp"


def list_scopes(t: GraphTables) -> DataFrame:
    """Registered scopes with the sizes of their graphs."""
    files = t.files.groupBy(F.col("scope").alias("id")).agg(F.count("*").alias("n_files"))
    symbols = t.symbols.groupBy(F.col("scope").alias("id")).agg(F.count("*").alias("n_symbols"))
    rows = t.scopes.select("id", "name", "root", "isolated", "status", "status_message").join(files, "id", "left").join(symbols, "id", "left")
    return rows.fillna(0, ["n_files", "n_symbols"])


def verify_scope(t: GraphTables, seen: DataFrame | None = None, sample: int = 20, seed: int = 0) -> dict[str, DataFrame]:
    """Integrity checks, row counts and the drift of a sample of files."""
    out = {"integrity": integrity(t), "counts": row_counts(t)}
    if seen is not None:
        few = sample_files(t, sample, seed)
        out["drift"] = drift(few, seen.join(few.select("scope", "path"), ["scope", "path"], "left_semi"))
    return out


def verify_embeddings(t: GraphTables) -> DataFrame:
    """(model_version, n_vectors, n_dimensions, n_damaged, n_stale): vectors of other lengths than most,
    with nulls, NaN or only zeros are damaged; those of symbols that don't exist any more are stale."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    lengths = t.embeddings.groupBy("model_version", F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.groupBy("model_version").agg(F.max_by("d", F.struct("n", "d")).alias("d"), F.count("*").alias("n_dimensions"))
    ids = t.symbols.select("scope", F.col("id").alias("symbol_id"), F.lit(True).alias("_known"))
    rows = t.embeddings.join(ids, ["scope", "symbol_id"], "left").join(usual, "model_version")
    damaged = ~F.coalesce(sound, F.lit(False)) | (F.size("embedding") != F.col("d"))
    return rows.groupBy("model_version", "n_dimensions").agg(F.count("*").alias("n_vectors"), F.sum(damaged.cast("long")).alias("n_damaged"), F.sum(F.col("_known").isNull().cast("long")).alias("n_stale")).select("model_version", "n_vectors", "n_dimensions", "n_damaged", "n_stale")


def repair_scope(store: SnapshotStore, mode: str = "minimal", scope: str | None = None, version: int | None = None) -> int:
    """minimal: drop what points at nothing (in one scope or all) and publish; rebuild: go back to
    ``version`` (the first by default).  The versions in between stay as the archive."""
    if mode == "rebuild":
        store.rollback(version or 1)
        return version or 1
    if mode != "minimal":
        raise ValueError(f"unknown mode: {mode}")
    t = store.read()
    ids = t.symbols.select("scope", "id")
    other = F.lit(False) if scope is None else F.col("scope") != scope

    def ok(rows, column, meant):
        mine = rows.filter(~other)
        kept = resolvable(t, mine, column) if meant else mine.join(ids.withColumnRenamed("id", column), ["scope", column], "left_semi").select(*rows.columns)
        return kept if scope is None else kept.unionByName(rows.filter(other))

    return store.publish(t.with_tables(
        edges=ok(ok(t.edges, "src", False), "dst", True), edge_evidence=ok(ok(t.edge_evidence, "src", False), "dst", True), refs=ok(t.refs, "symbol_id", True), annotations=ok(t.annotations, "symbol_id", False)
    ))


def reconcile_drift(t: GraphTables, seen: DataFrame, max_files: int = 1000, dry_run: bool = False, complete: bool = True, index: Callable[[GraphTables, DataFrame], GraphTables] | None = None) -> tuple[DataFrame, GraphTables]:
    """Changes against a walk, and the tables without the removed files.  ``index`` (tables and the
    changes added or changed, to tables) reads the other files' facts in; without it they stay as
    they are.  More changes than ``max_files`` are refused."""
    if not 1 <= max_files <= 50_000:
        raise ValueError("max_files must be 1 to 50000")
    changes = drift(t.files, seen, complete).filter("change != 'unchanged'")
    if changes.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files differ")
    if dry_run:
        return changes, t
    removed = t.files.join(changes.filter("change = 'removed'").select("scope", "path"), ["scope", "path"], "left_semi").select("scope", F.col("id").alias("file_id"))
    left = delete_files(t, removed)
    return changes, left if index is None else index(left, changes.filter("change in ('added', 'changed')"))


def append_usage(spark: SparkSession, path: str, calls: list[tuple]) -> None:
    """Append calls (tool, ms, ok, bytes, at) to a JSON-lines log."""
    spark.createDataFrame(calls, USAGE).write.mode("append").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).json(path)


def markdown_table(rows: DataFrame, most: int = 96) -> str:
    """A bounded result as a Markdown table."""
    shown = rows.limit(most + 1).collect()
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(clean(v) for v in r) + " |" for r in shown[:most]]
    return "\n".join(lines + (["", "(more rows were left out)"] if len(shown) > most else []))


@dataclass
class Registry:
    """Hooks: tools (name to a function of the tables), analyzers (tables to tables), module resolvers,
    tables of node kinds by language, and indexers
    (a language's name to a function of raw files to fact rows, by their endings).  An analyzer that
    fails or takes longer than ``seconds`` leaves the tables as they were; its tables are written
    before the next one runs, so failures can't surface later."""

    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    analyzers: dict[str, Callable[[GraphTables], GraphTables]] = field(default_factory=dict)
    indexers: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    resolvers: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    node_kinds: dict[str, dict[str, str]] = field(default_factory=dict)
    seconds: float = 30.0

    def add_tool(self, name: str, run: Callable[..., DataFrame]) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name} exists")
        self.tools[name] = run

    def call(self, name: str, t: GraphTables, **parameters) -> DataFrame:
        return self.tools[name](t, **parameters)

    def add_indexer(self, name: str, endings: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> None:
        taken = {e for es, _ in self.indexers.values() for e in es} & set(endings)
        if taken:
            raise ValueError(f"endings in use: {', '.join(sorted(taken))}")
        self.indexers[name] = (endings, run)

    def index(self, files: DataFrame) -> dict[str, DataFrame]:
        """Fact rows by language: each indexer gets the files (path, ...) with its endings."""
        ends = lambda es: functools.reduce(lambda a, e: a | F.lower("path").endswith(e.lower()), es, F.lit(False))
        return {name: run(files.filter(ends(endings))) for name, (endings, run) in self.indexers.items()}

    def resolve_modules(self, wanted: DataFrame) -> DataFrame:
        """(scope, specifier, path): module names (scope, specifier) as files; each resolver is asked for
        what those before it left open, and what none knows has a null path."""
        rest, done = wanted.select("scope", "specifier").distinct(), None
        for resolve in self.resolvers:
            hit = resolve(rest).select("scope", "specifier", "path").filter("path is not null").groupBy("scope", "specifier").agg(F.min("path").alias("path"))
            done = hit if done is None else done.unionByName(hit)
            rest = rest.join(hit, ["scope", "specifier"], "left_anti")
        open_ = rest.withColumn("path", F.lit(None).cast("string"))
        return open_ if done is None else done.unionByName(open_)

    def map_kinds(self, nodes: DataFrame) -> DataFrame:
        """Add ``kind_name`` to syntax nodes (language, node_kind, ...) by the languages' tables; nodes of
        other kinds declare nothing and are left out."""
        rows = [(language, node, kind) for language, table in self.node_kinds.items() for node, kind in table.items()]
        table = nodes.sparkSession.createDataFrame(rows, "language string, node_kind string, kind_name string")
        return nodes.join(F.broadcast(table), ["language", "node_kind"])  # a row per kind of node of a grammar

    def analyze(self, t: GraphTables) -> tuple[GraphTables, dict[str, str]]:
        spark, failed = t.files.sparkSession, {}
        for name, run in self.analyzers.items():
            tag, late = f"analyzer-{uuid.uuid4().hex}", threading.Event()

            def stop(tag=tag, late=late):
                late.set()
                spark.interruptTag(tag)

            timer = threading.Timer(self.seconds, stop)
            spark.addTag(tag)
            timer.start()
            try:
                done = run(t)
                changed = {n: cut(getattr(done, n)) for n in SCHEMAS if getattr(done, n) is not getattr(t, n)}
                if late.is_set():
                    raise TimeoutError(f"took more than {self.seconds} s")
                t = t.with_tables(**changed)
            except Exception as error:  # noqa: BLE001
                failed[name] = f"took more than {self.seconds} s" if late.is_set() else str(error).split("\n")[0]
            finally:
                timer.cancel()
                spark.removeTag(tag)
        return t, failed
