"""Merges of facts: pure functions from old tables to new ones.

Nothing is changed in place.  A merge returns frames; ``SnapshotStore`` writes them as a new version
and then adds a pointer file, so readers see the old version or the new one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.scoped import resolvable
from codeloom.session import cut
from codeloom.tables import KEYS, SHARED, GraphTables, empty_tables, load_tables, save_tables

EDGE = ["scope", "src", "dst", "kind_name"]
PLACE = ["producing_file_id", "file_path", "start_line", "start_col", "end_line", "end_col", "confidence", "producer", "payload"]


def _stable_id(*columns) -> Column:
    """An id that depends on the row alone, so that it needs no sequence and no shuffle."""
    return F.abs(F.xxhash64(*[F.col(c) for c in columns]) % F.lit(1 << 62))


def _latest(rows: DataFrame, keys) -> DataFrame:
    """One row per key; of repeated ones the greatest, so the result doesn't depend on their order."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(_latest(new, list(keys)))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (scope, path); a known path keeps its id, a new one gets a stable id."""
    rows = _latest(new.select("scope", "path", "content_sha256", "last_indexed_at", "is_generated"), ["scope", "path"])
    ids = old.select("scope", "path", F.col("id").alias("old_id"))
    merged = rows.join(ids, ["scope", "path"], "left").withColumn("id", F.coalesce("old_id", _stable_id("scope", "path"))).drop("old_id")
    return old.join(rows.select("scope", "path"), ["scope", "path"], "left_anti").unionByName(merged.select(*old.columns))


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (scope, canonical_key).  A known key keeps its id and, if the new row says nothing, its test
    framework; its container is what the new row says (null resets it)."""
    rows = _latest(new.drop("id"), ["scope", "canonical_key"])
    kept = old.select("scope", "canonical_key", F.col("id").alias("old_id"), F.col("test_framework").alias("old_framework"))
    merged = rows.join(kept, ["scope", "canonical_key"], "left")
    merged = merged.withColumn("id", F.coalesce("old_id", _stable_id("scope", "canonical_key"))).withColumn("test_framework", F.coalesce("test_framework", "old_framework"))
    return old.join(rows.select("scope", "canonical_key"), ["scope", "canonical_key"], "left_anti").unionByName(merged.select(*old.columns))


def set_column(old: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Batch update of one column by (scope, id); rows without a change keep their value."""
    one = _latest(changes.select("scope", "id", F.col(column).alias("_new")), ["scope", "id"]).withColumn("_hit", F.lit(True))
    joined = old.join(one, ["scope", "id"], "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
    return joined.select(*old.columns)


def insert_refs(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns))


def logical_edges(edges: DataFrame, evidence: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Edges with the payload of their surviving evidence with the least id ('' as null).  With
    ``touched`` (edge keys), touched edges without evidence are dropped and others stay as they are."""
    first = evidence.groupBy(*EDGE).agg(F.min_by("payload", "id").alias("_payload"), F.lit(True).alias("_has"))
    joined = edges.join(first, EDGE, "left")
    if touched is not None:
        joined = joined.join(touched.select(*EDGE).distinct().withColumn("_touched", F.lit(True)), EDGE, "left")
    else:
        joined = joined.withColumn("_touched", F.lit(True))
    kept = joined.filter("_has or _touched is null")
    payload = F.when(F.col("_touched"), F.nullif(F.col("_payload"), F.lit(""))).otherwise(F.col("payload"))
    return kept.select(*EDGE, payload.alias("payload"))


def insert_edges(t: GraphTables, edges: DataFrame, evidence: DataFrame) -> GraphTables:
    """Insert edges and evidence, ignoring those that exist.  A new edge without evidence gets an
    inferred one at its source's declaration."""
    fresh = _latest(edges.select(*EDGE, "payload"), EDGE).join(t.edges.select(*EDGE), EDGE, "left_anti")
    given = evidence.select(*EDGE, *PLACE).withColumn("payload", F.coalesce("payload", F.lit(""))).dropDuplicates([*EDGE, *PLACE])
    bare = fresh.join(given.select(*EDGE).distinct(), EDGE, "left_anti")
    at = t.symbols.select("scope", F.col("id").alias("src"), "file_id", "start_line", "start_col", "end_line", "end_col")
    at = at.join(t.files.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"])
    legacy = bare.join(at, ["scope", "src"]).select(
        *EDGE, F.col("file_id").alias("producing_file_id"), F.col("path").alias("file_path"), "start_line", "start_col", "end_line", "end_col", F.lit(0).alias("confidence"), F.lit("legacy-declaration").alias("producer"), F.coalesce("payload", F.lit("")).alias("payload")
    )
    every = given.unionByName(legacy)
    known = t.edge_evidence.select(*EDGE, *PLACE)
    missing = every.join(known.withColumn("_known", F.lit(True)), [*EDGE, *PLACE], "left_anti")
    new_evidence = missing.withColumn("id", _stable_id(*EDGE, *PLACE)).select(*t.edge_evidence.columns)
    all_evidence = t.edge_evidence.unionByName(new_evidence)
    touched = fresh.select(*EDGE).union(missing.select(*EDGE))
    all_edges = t.edges.unionByName(fresh.select(*t.edges.columns))
    return t.with_tables(edge_evidence=all_evidence, edges=logical_edges(all_edges, all_evidence, touched))


def _drop_evidence(t: GraphTables, gone: DataFrame, evidence: DataFrame) -> GraphTables:
    """Keep ``evidence``; edges that lost some of it lose their payload or vanish with the last."""
    return t.with_tables(edge_evidence=evidence, edges=logical_edges(t.edges, evidence, gone))


def clear_file_outgoing(t: GraphTables, files: DataFrame, keep_producers=()) -> GraphTables:
    """Remove the files' evidence (of producers that aren't kept) and references, then edges that
    have no evidence left."""
    owned = files.select("scope", F.col("file_id").alias("producing_file_id")).distinct().withColumn("_own", F.lit(True))
    marked = t.edge_evidence.join(owned, ["scope", "producing_file_id"], "left")
    out = F.coalesce(F.col("_own"), F.lit(False)) & ~F.col("producer").isin(list(keep_producers)) if keep_producers else F.coalesce(F.col("_own"), F.lit(False))
    cleared = _drop_evidence(t, marked.filter(out), marked.filter(~out).select(*t.edge_evidence.columns))
    return cleared.with_tables(refs=t.refs.join(files.select("scope", "file_id").distinct(), ["scope", "file_id"], "left_anti"))


def clear_producer(t: GraphTables, producer: str, files: DataFrame | None = None, scope: str | None = None) -> GraphTables:
    """Remove one producer's evidence, of some files or of a whole scope."""
    if (files is None) == (scope is None):
        raise ValueError("name files or a scope")
    out = F.col("producer") == producer
    if files is None:
        marked = t.edge_evidence.withColumn("_own", F.col("scope") == scope)
    else:
        owned = files.select("scope", F.col("file_id").alias("producing_file_id")).distinct().withColumn("_own", F.lit(True))
        marked = t.edge_evidence.join(owned, ["scope", "producing_file_id"], "left")
    out = out & F.coalesce(F.col("_own"), F.lit(False))
    return _drop_evidence(t, marked.filter(out), marked.filter(~out).select(*t.edge_evidence.columns))


class UnresolvedEndpoint(ValueError):
    """A replacement names a symbol that doesn't exist; the whole batch is refused."""


def resolve_endpoints(t: GraphTables, facts: DataFrame) -> DataFrame:
    """(scope, src_key, dst_key, ...) to (scope, src, dst, ...); a target may be a shared symbol."""
    src = t.symbols.select("scope", F.col("canonical_key").alias("src_key"), F.col("id").alias("src"))
    dst = t.symbols.select("scope", F.col("canonical_key").alias("dst_key"), F.col("id").alias("dst"))
    common = dst.filter(F.col("scope") == SHARED).select("dst_key", F.col("dst").alias("_common"))
    rows = facts.join(src, ["scope", "src_key"], "left").join(dst, ["scope", "dst_key"], "left").join(common, "dst_key", "left")
    rows = rows.withColumn("dst", F.coalesce("dst", "_common")).drop("_common")
    if not rows.filter("src is null or dst is null").limit(1).isEmpty():
        raise UnresolvedEndpoint("the batch names unknown symbols")
    return rows.drop("src_key", "dst_key")


def replace_producer(t: GraphTables, producer: str, facts: DataFrame, files: DataFrame | None = None, scope: str | None = None) -> GraphTables:
    """Replace all that a producer said (of some files or of a whole scope) by facts with canonical
    keys: scope, src_key, dst_key, kind_name and the columns of a piece of evidence.  Facts of another
    scope than the one named refuse the batch."""
    if scope is not None and not facts.filter(~F.col("scope").eqNullSafe(F.lit(scope))).limit(1).isEmpty():
        raise UnresolvedEndpoint("the batch holds facts of another scope")
    evidence = resolve_endpoints(t, facts).withColumn("producer", F.lit(producer)).withColumn("payload", F.coalesce("payload", F.lit("")))
    cleared = clear_producer(t, producer, files, scope)
    return insert_edges(cleared, evidence.select(*EDGE, F.nullif(F.col("payload"), F.lit("")).alias("payload")), evidence)


def replace_annotations(t: GraphTables, files: DataFrame, flavors, new: DataFrame) -> DataFrame:
    """Annotations of listed flavors on symbols of the files, replaced by the new ones."""
    inside = t.symbols.join(files.select("scope", "file_id").distinct(), ["scope", "file_id"], "left_semi").select("scope", F.col("id").alias("symbol_id"), F.lit(True).alias("_in"))
    kept = t.annotations.join(inside, ["scope", "symbol_id"], "left").filter(F.col("_in").isNull() | ~F.col("flavor").isin(list(flavors))).select(*t.annotations.columns)
    return kept.unionByName(new.select(*t.annotations.columns))


def replace_file_projection(t: GraphTables, producer: str, files: DataFrame, flavors, facts: DataFrame, annotations: DataFrame) -> GraphTables:
    """A derived projection of several files at once: edges of a producer and annotations."""
    return replace_producer(t, producer, facts, files).with_tables(annotations=replace_annotations(t, files, flavors, annotations))


def delete_symbols(t: GraphTables, gone: DataFrame) -> GraphTables:
    """Remove symbols (scope, id) and all that depends on them (of a shared symbol in all scopes);
    children lose their container and annotations their attribute symbol."""
    ids = cut(gone.select("scope", "id").distinct())  # many joins read them
    by = lambda c: ids.withColumnRenamed("id", c)
    anti = lambda rows, c: rows.join(by(c), ["scope", c], "left_anti").select(*rows.columns)
    lost = lambda rows, c: resolvable(t, rows, c, ids, "left_anti")
    blank = lambda rows, c: rows.join(by(c).withColumn("_gone", F.lit(True)), ["scope", c], "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).select(*rows.columns)
    return t.with_tables(
        symbols=blank(anti(t.symbols, "id"), "container_id"), refs=lost(t.refs, "symbol_id"), edges=lost(anti(t.edges, "src"), "dst"), edge_evidence=lost(anti(t.edge_evidence, "src"), "dst"),
        annotations=blank(anti(t.annotations, "symbol_id"), "attribute_symbol_id"), diagnostics=anti(t.diagnostics, "symbol_id"), symbol_history=anti(t.symbol_history, "symbol_id"), embeddings=anti(t.embeddings, "symbol_id"),
    )


def reconcile_declarations(t: GraphTables, files: DataFrame, kept_keys: DataFrame) -> GraphTables:
    """Drop symbols of the files that aren't declared any more (kept_keys: scope, canonical_key)."""
    inside = t.symbols.join(files.select("scope", "file_id").distinct(), ["scope", "file_id"], "left_semi")
    return delete_symbols(t, inside.join(kept_keys.select("scope", "canonical_key").distinct(), ["scope", "canonical_key"], "left_anti"))


def delete_files(t: GraphTables, files: DataFrame) -> GraphTables:
    """Remove files (scope, file_id), their symbols, references, diagnostics and evidence."""
    few = files.select("scope", "file_id").distinct()
    inside = t.symbols.join(few, ["scope", "file_id"], "left_semi")
    cleared = delete_symbols(clear_file_outgoing(t, few), inside)
    return cleared.with_tables(
        files=t.files.join(few.withColumnRenamed("file_id", "id"), ["scope", "id"], "left_anti").select(*t.files.columns), diagnostics=cleared.diagnostics.join(few, ["scope", "file_id"], "left_anti").select(*t.diagnostics.columns)
    )


def purge_excluded(t: GraphTables, excluded) -> GraphTables:
    """Remove files whose path an exclusion rule now covers (a function of the path column)."""
    return delete_files(t, t.files.filter(excluded(F.col("path"))).select("scope", F.col("id").alias("file_id")))


def replace_native_snapshot(t: GraphTables, producer: str, scopes: DataFrame, flavors, facts: DataFrame, annotations: DataFrame) -> GraphTables:
    """Publish a whole candidate of native facts: everything the producer said before and all
    annotations of the flavors in these scopes (scope) give way.  A candidate that names unknown
    symbols, or annotations of other flavors or unknown symbols, is refused as a whole."""
    ids = t.symbols.select("scope", F.col("id").alias("symbol_id"))
    foreign = annotations.filter(~F.col("flavor").isin(list(flavors)))
    if not foreign.limit(1).isEmpty() or not annotations.join(ids, ["scope", "symbol_id"], "left_anti").limit(1).isEmpty():
        raise UnresolvedEndpoint("the candidate holds annotations of other flavors or of unknown symbols")
    inside = scopes.select("scope").distinct()
    files = t.files.join(inside, "scope", "left_semi").select("scope", F.col("id").alias("file_id"))
    replaced = replace_producer(t, producer, facts, files)
    old = t.annotations.join(inside.withColumn("_in", F.lit(True)), "scope", "left").filter(F.col("_in").isNull() | ~F.col("flavor").isin(list(flavors)))
    return replaced.with_tables(annotations=old.select(*t.annotations.columns).unionByName(annotations.select(*t.annotations.columns)))


def replace_diagnostics(t: GraphTables, files: DataFrame, new: DataFrame) -> DataFrame:
    kept = t.diagnostics.join(files.select("scope", "file_id").distinct(), ["scope", "file_id"], "left_anti").select(*t.diagnostics.columns)
    return kept.unionByName(new.select(*t.diagnostics.columns))


def upsert_history(t: GraphTables, new: DataFrame) -> DataFrame:
    return upsert(t.symbol_history, new.select(*t.symbol_history.columns), KEYS["symbol_history"])


def replace_file_facts(t: GraphTables, files: DataFrame, symbols: DataFrame, edges: DataFrame, annotations: DataFrame, refs: DataFrame) -> GraphTables:
    """All facts of some files at once.  files: as upsert_files; symbols: without ids, with ``path``
    for the file and ``container_key``; edges: src_key, dst_key, kind_name and evidence; annotations
    and refs: symbol_key and ``path``.  Symbols that are gone are removed with their dependents;
    an unknown endpoint refuses the batch."""
    stored = cut(upsert_files(t.files, files))
    ids = stored.join(files.select("scope", "path").distinct(), ["scope", "path"], "left_semi").select("scope", "path", F.col("id").alias("file_id"))
    few = ids.select("scope", "file_id")
    declared = symbols.join(ids, ["scope", "path"])
    merged = upsert_symbols(t.symbols, declared.withColumn("container_id", F.lit(None).cast("long")).select(*t.symbols.columns) if "id" in declared.columns else declared.withColumn("id", F.lit(None).cast("long")).withColumn("container_id", F.lit(None).cast("long")).select(*t.symbols.columns))
    keys = merged.select("scope", "canonical_key", "id")
    boxes = declared.filter("container_key is not null").select("scope", "canonical_key", F.col("container_key").alias("box")).join(keys, ["scope", "canonical_key"])
    boxes = boxes.join(keys.select("scope", F.col("canonical_key").alias("box"), F.col("id").alias("container_id")), ["scope", "box"]).select("scope", "id", "container_id")
    base = t.with_tables(files=stored, symbols=cut(set_column(merged, boxes, "container_id")))
    base = reconcile_declarations(clear_file_outgoing(base, few), few, symbols.select("scope", "canonical_key"))
    base = base.with_tables(symbols=cut(base.symbols), edges=cut(base.edges), edge_evidence=cut(base.edge_evidence))
    evidence = resolve_endpoints(base, edges.join(ids.withColumnRenamed("file_id", "producing_file_id").withColumnRenamed("path", "file_path"), ["scope", "file_path"]))
    base = insert_edges(base, evidence.select(*EDGE, "payload"), evidence)
    named = keys.select("scope", F.col("canonical_key").alias("symbol_key"), F.col("id").alias("symbol_id"))
    marks = annotations.join(named, ["scope", "symbol_key"]).withColumn("id", _stable_id("scope", "symbol_key", "name", "flavor", "args_json")).withColumn("attribute_symbol_id", F.lit(None).cast("long"))
    inside = base.symbols.join(few, ["scope", "file_id"], "left_semi").select("scope", F.col("id").alias("symbol_id"))
    kept = base.annotations.join(inside, ["scope", "symbol_id"], "left_anti").select(*t.annotations.columns)
    seen = refs.join(named, ["scope", "symbol_key"]).join(ids, ["scope", "path"]).withColumn("id", _stable_id("scope", "symbol_key", "path", "line", "col", "kind"))
    return base.with_tables(annotations=kept.unionByName(marks.select(*t.annotations.columns)), refs=base.refs.select(*t.refs.columns).unionByName(seen.select(*t.refs.columns)))


def orphan_symbols(t: GraphTables, requested: DataFrame) -> DataFrame:
    """Requested keys (scope, canonical_key) whose symbol nothing refers to any more."""
    rows = t.symbols.join(requested.select("scope", "canonical_key").distinct(), ["scope", "canonical_key"], "left_semi").select("scope", "id", "canonical_key")
    users = [(t.annotations, "symbol_id"), (t.refs, "symbol_id"), (t.edges, "src"), (t.edges, "dst"), (t.edge_evidence, "src"), (t.edge_evidence, "dst"), (t.diagnostics, "symbol_id"), (t.symbol_history, "symbol_id"), (t.embeddings, "symbol_id"), (t.symbols, "container_id")]
    for frame, column in users:
        rows = rows.join(frame.filter(F.col(column).isNotNull()).select("scope", F.col(column).alias("id")).distinct(), ["scope", "id"], "left_anti")
    return rows


def insert_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """First observations only; of several new ones the earliest."""
    keys = ["scope", "symbol_canonical_key"]
    first = new.groupBy(*keys).agg(F.min_by(F.struct("contract_json", "file_path", "observed_at"), F.struct("observed_at", "contract_json")).alias("r")).select(*keys, "r.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def to_embed(wanted: DataFrame, stored: DataFrame, model_version: str) -> DataFrame:
    """Texts (scope, symbol_id, content_hash) whose vector is missing or stale."""
    have = stored.select("scope", "symbol_id", F.col("content_hash").alias("_hash"), F.col("model_version").alias("_model"))
    rows = wanted.join(have, ["scope", "symbol_id"], "left")
    return rows.filter(~(F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_model").eqNullSafe(F.lit(model_version)))).drop("_hash", "_model")


def upsert_embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(stored, new.select(*stored.columns), ["scope", "symbol_id"])


def prune_embeddings(stored: DataFrame, symbols: DataFrame) -> DataFrame:
    return stored.join(symbols.select("scope", F.col("id").alias("symbol_id")), ["scope", "symbol_id"], "left_semi").select(*stored.columns)


def drift(stored: DataFrame, seen: DataFrame, complete: bool = True) -> DataFrame:
    """(scope, path, change): added, changed, removed or unchanged files against what a walk saw
    (scope, path, content_sha256).  A partial walk proves no removal."""
    old = stored.select("scope", "path", F.col("content_sha256").alias("_old"), F.lit(True).alias("_had"))
    new = seen.select("scope", "path", F.col("content_sha256").alias("_new"), F.lit(True).alias("_has"))
    change = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    rows = old.join(new, ["scope", "path"], "full").select("scope", "path", change.alias("change"))
    return rows if complete else rows.filter("change != 'removed'")


def scope_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): scopes added, removed or replaced (root, name or isolation differ)."""
    columns = ["name", "root", "isolated"]
    a = old.select("id", F.struct(*columns).alias("_old"))
    b = new.select("id", F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "replaced")
    return a.join(b, "id", "full").select("id", change.alias("change")).filter("change is not null")


class SnapshotStore:
    """Versions of a bundle below one folder: ``v=<n>/<table>`` and, in ``pointers``, numbered files that
    each name the version readers use; the one with the highest number counts.

    Nothing is overwritten or deleted.  Versions and pointers are created under new numbers only, so
    a reader always sees a whole version, a writer that was overtaken is refused, and what a crash
    leaves behind (a version without a pointer, a pointer file that isn't whole) is passed over.
    Works on any file system that Spark writes to and that refuses to create a file twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._p(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _create(self, path: str, text: str) -> bool:
        """Write a new file; false if it exists already."""
        try:
            out = self._fs.create(self._p(path), False)
        except Exception as error:  # noqa: BLE001
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def _pointers(self) -> list[int]:
        return sorted((int(n[:-5]) for n in self._names(f"{self.path}/pointers") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _pointer(self) -> dict:
        for number in self._pointers():
            text = self.spark.read.text(f"{self.path}/pointers/{number:012d}.json", wholetext=True).collect()
            try:
                found = json.loads(text[0][0])
                return {"number": number, "version": int(found["version"]), "batches": dict(found["batches"])}
            except (IndexError, KeyError, TypeError, ValueError):
                continue  # its writer died
        return {"number": 0, "version": 0, "batches": {}}

    def current(self) -> int:
        """The version that readers use; 0 if none was published yet."""
        return self._pointer()["version"]

    def last_batch(self, stream: str) -> int:
        """Number of the last micro-batch of a stream that was published; -1 if none was."""
        return self._pointer()["batches"].get(stream, -1)

    def read(self, version: int | None = None) -> GraphTables:
        """A version's tables.  One that doesn't exist, or isn't whole, is an error; a store that
        nothing was published to is empty."""
        version = self.current() if version is None else version
        return load_tables(self.spark, f"{self.path}/v={version}", whole=True) if version else empty_tables(self.spark)

    def _claim(self) -> int:
        """A version number that nobody else uses or has used."""
        taken = [int(n[2:]) for n in self._names(self.path) if n.startswith("v=") and n[2:].isdigit()]
        taken += [int(n) for n in self._names(f"{self.path}/claims") if n.isdigit()]
        version = max(taken, default=0) + 1
        while not self._create(f"{self.path}/claims/{version}", ""):
            version += 1
        return version

    def publish(self, tables: GraphTables, expected: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Write a new version, then point at it; refuses if another writer pointed elsewhere since.
        The number of a stream's micro-batch is kept in the pointer, so both change at once."""
        pointer = self._pointer()
        if expected is not None and expected != pointer["version"]:
            raise RuntimeError(f"version {pointer['version']} is current, not {expected}")
        version, newest = self._claim(), max(self._pointers(), default=0)
        save_tables(tables, f"{self.path}/v={version}")
        if self._pointer()["number"] != pointer["number"]:
            raise RuntimeError("another writer has published meanwhile")
        self._point(newest, version, pointer["batches"] | dict([batch] if batch else []))
        return version

    def _point(self, newest: int, version: int, batches: dict) -> None:
        text = json.dumps({"version": version, "batches": batches})
        if not self._create(f"{self.path}/pointers/{newest + 1:012d}.json", text):
            raise RuntimeError("another writer has published meanwhile")

    def rollback(self, version: int) -> None:
        """Point at an older version; later versions stay, and their numbers aren't used again."""
        if not self._fs.exists(self._p(f"{self.path}/v={version}")):
            raise ValueError(f"no version {version}")
        self._point(max(self._pointers(), default=0), version, self._pointer()["batches"])


def integrity(t: GraphTables) -> DataFrame:
    """(check, n_rows): rows that point at nothing, and keys that repeat."""
    parts = []

    def dangling(name, rows, column, target):
        ids = target.select("scope", F.col("id").alias(column))
        lost = rows.filter(F.col(column).isNotNull())
        lost = resolvable(t, lost, column, how="left_anti") if name in ("refs.symbol_id", "edges.dst") else lost.join(ids, ["scope", column], "left_anti")
        parts.append(lost.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("check"), "n_rows"))

    dangling("symbols.file_id", t.symbols, "file_id", t.files)
    dangling("symbols.container_id", t.symbols, "container_id", t.symbols)
    dangling("refs.symbol_id", t.refs, "symbol_id", t.symbols)
    dangling("refs.file_id", t.refs, "file_id", t.files)
    dangling("edges.src", t.edges, "src", t.symbols)
    dangling("edges.dst", t.edges, "dst", t.symbols)
    dangling("annotations.symbol_id", t.annotations, "symbol_id", t.symbols)
    for name in ("files", "symbols", "edges"):
        repeated = getattr(t, name).groupBy(*KEYS[name]).count().filter("count > 1")
        parts.append(repeated.agg(F.count("*").alias("n_rows")).select(F.lit(f"{name} repeated").alias("check"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

