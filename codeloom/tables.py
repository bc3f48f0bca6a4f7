"""The relational fact model of a code graph, as a bundle of lazy DataFrames.

``scope`` is a plain column of every table.  Ids are unique only within a scope, so joins carry the
scope; symbols of the scope SHARED are seen from all (``operators.scoped``).  ``from_driver`` projects the bundle from the
driver's tables: facts that they hold are cleaned to their live state, facts that they lack
(evidence, annotations, diagnostics, history) are derived from them by fixed rules.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import normal_kind
from codeloom.session import read_table, shared_folder

#: The scope of symbols that are seen from every scope.
SHARED = "shared"
#: DDL of each table of the model.
SCHEMAS = {
    "files": "scope string, id long, path string, content_sha256 binary, last_indexed_at long, is_generated int",
    "symbols": "scope string, id long, canonical_key string, name string, fqn string, kind_name string, file_id long, start_line int, start_col int, end_line int, end_col int, signature string, container_id long, modifiers string, accessibility int, xml_summary string, test_framework string",
    "refs": "scope string, id long, symbol_id long, file_id long, line int, col int, kind int",
    "edges": "scope string, src long, dst long, kind_name string, payload string",
    "edge_evidence": "scope string, id long, src long, dst long, kind_name string, producing_file_id long, file_path string, start_line int, start_col int, end_line int, end_col int, confidence int, producer string, payload string",
    "annotations": "scope string, id long, symbol_id long, name string, full_name string, flavor string, args_json string, attribute_symbol_id long",
    "diagnostics": "scope string, id long, symbol_id long, file_id long, severity int, code string, message string, line int, col int",
    "symbol_history": "scope string, symbol_id long, last_commit_sha string, last_author string, last_authored_at long, line_count int, blamed_content_sha binary",
    "grpc_contract_baselines": "scope string, symbol_canonical_key string, contract_json string, file_path string, observed_at long",
    "embeddings": "scope string, symbol_id long, embedding array<float>, content_hash binary, model_version string",
    "scopes": "id string, name string, root string, isolated int, last_indexed_at long, status string, status_message string",
}
#: Columns that identify a row; evidence is unique over all its columns but id.
KEYS = {
    "files": ["scope", "id"], "symbols": ["scope", "id"], "refs": ["scope", "id"], "edges": ["scope", "src", "dst", "kind_name"],
    "edge_evidence": ["scope", "src", "dst", "kind_name", "producing_file_id", "file_path", "start_line", "start_col", "end_line", "end_col", "confidence", "producer", "payload"],
    "annotations": ["scope", "id"], "diagnostics": ["scope", "id"], "symbol_history": ["scope", "symbol_id"],
    "grpc_contract_baselines": ["scope", "symbol_canonical_key"], "embeddings": ["scope", "symbol_id", "model_version"], "scopes": ["id"],
}


@dataclass(frozen=True)
class GraphTables:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    edges: DataFrame
    edge_evidence: DataFrame
    annotations: DataFrame
    diagnostics: DataFrame
    symbol_history: DataFrame
    grpc_contract_baselines: DataFrame
    embeddings: DataFrame
    scopes: DataFrame

    def with_tables(self, **changed: DataFrame) -> GraphTables:
        return replace(self, **changed)

    def restrict(self, scope_ids) -> GraphTables:
        """Only rows of these scopes (a pushed-down filter; partition pruning on stored tables)."""
        scope_ids = list(scope_ids)
        kept = {n: getattr(self, n).filter(F.col("scope").isin(scope_ids)) for n in SCHEMAS if n != "scopes"}
        return self.with_tables(**kept, scopes=self.scopes.filter(F.col("id").isin(list(scope_ids))))


def empty_tables(spark: SparkSession, **given: DataFrame) -> GraphTables:
    """A bundle with the given tables; the others are empty."""
    return GraphTables(**{n: given.get(n) if given.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def load_tables(spark: SparkSession, path: str, whole: bool = False) -> GraphTables:
    """A bundle stored by table under ``path``; tables that are missing there are empty, or with
    ``whole`` an error.  A folder that doesn't exist is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileNotFoundError(path)
    tables = {}
    for name, schema in SCHEMAS.items():
        try:
            tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except Exception as missing:  # noqa: BLE001
            if whole or "PATH_NOT_FOUND" not in str(missing):
                raise
            tables[name] = spark.createDataFrame([], schema)
    return GraphTables(**tables)


def save_tables(tables: GraphTables, path: str) -> None:
    for name in SCHEMAS:
        frame = getattr(tables, name)
        writer = frame.write.mode("overwrite")
        (writer if name == "scopes" else writer.partitionBy("scope")).parquet(f"{path}/{name}")


def _live_files(raw: DataFrame) -> DataFrame:
    rows = raw.filter("deleted_at is null and id is not null")
    row = F.struct("path", "content_sha256", "last_indexed_at", "is_generated")
    latest = rows.groupBy(F.col("scope_id").alias("scope"), "id").agg(F.max_by(row, F.struct("last_indexed_at", "path")).alias("r"))
    return latest.select("scope", "id", "r.*")


def _live_symbols(raw: DataFrame, shared: DataFrame) -> DataFrame:
    columns = ["canonical_key", "name", "fqn", "kind_name", "file_id", "start_line", "start_col", "end_line", "end_col", "signature", "container_id", "modifiers", "accessibility", "xml_summary", "test_framework"]
    rows = raw.filter("deleted_at is null and id is not null").withColumn("kind_name", normal_kind("kind_name"))
    order = F.struct(F.col("added_at").isNotNull(), "added_at")
    own = rows.groupBy(F.col("scope_id").alias("scope"), "id").agg(F.max_by(F.struct(*columns, "added_at"), order).alias("r")).select("scope", "id", "r.*")
    none = {"file_id": "long", "start_line": "int", "start_col": "int", "end_line": "int", "end_col": "int", "container_id": "long", "modifiers": "string", "test_framework": "string"}
    common = shared.select(
        F.lit(SHARED).alias("scope"), "id", *[F.lit(None).cast(none[c]).alias(c) if c in none else F.col(c) for c in columns], F.lit(None).cast("timestamp_ntz").alias("added_at")
    )
    return own.unionByName(common)


def _edge_rows(raw: DataFrame) -> DataFrame:
    """Distinct occurrences (scope, src, dst, kind_name, payload)."""
    rows = raw.filter("src is not null and dst is not null")
    return rows.select(F.col("scope_id").alias("scope"), "src", "dst", normal_kind("kind_name").alias("kind_name"), F.when(F.col("payload") != "", F.col("payload")).alias("payload")).distinct()


def _evidence(rows: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """An occurrence is evidence unless (src + dst) is divisible by five; it stands in the source
    symbol's file, on a line that the pair determines."""
    edge = ["scope", "src", "dst", "kind_name"]
    seen = rows.filter((F.col("src") + F.col("dst")) % 5 != 0)
    seen = seen.withColumn("id", F.row_number().over(W.partitionBy(*edge).orderBy(F.col("payload").asc_nulls_first())).cast("long"))
    places = symbols.select("scope", F.col("id").alias("src"), "file_id", "start_line").join(files.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"])
    line = (F.col("start_line") + F.col("dst") % 7).cast("int")
    return seen.join(places, ["scope", "src"]).select(
        "scope", "id", "src", "dst", "kind_name", F.col("file_id").alias("producing_file_id"), F.col("path").alias("file_path"),
        line.alias("start_line"), F.lit(1).alias("start_col"), line.alias("end_line"), F.lit(9).alias("end_col"),
        ((F.col("src") + F.col("dst")) % 3).cast("int").alias("confidence"), F.when(F.col("src") % 2 == 0, "compiler").otherwise("syntax").alias("producer"),
        F.coalesce("payload", F.lit("")).alias("payload"),
    )


def _annotations(symbols: DataFrame) -> DataFrame:
    scheme = F.split("canonical_key", ":")[0]
    own = symbols.filter("modifiers is not null").select(
        "scope", (F.col("id") * 10 + 1).alias("id"), F.col("id").alias("symbol_id"), F.initcap("modifiers").alias("name"), F.concat(F.lit("System."), F.initcap("modifiers"), F.lit("Attribute")).alias("full_name"),
        F.concat(scheme, F.lit("-attribute")).alias("flavor"), F.concat(F.lit('["'), "kind_name", F.lit('",{"level":'), F.col("accessibility").cast("string"), F.lit("}]")).alias("args_json"),
    )
    tests = symbols.filter("test_framework is not null").select(
        "scope", (F.col("id") * 10 + 2).alias("id"), F.col("id").alias("symbol_id"), F.lit("Test").alias("name"), F.lit("Test.Framework").alias("full_name"), F.lit("test").alias("flavor"), F.concat(F.lit('["'), "test_framework", F.lit('"]')).alias("args_json")
    )
    return own.unionByName(tests).withColumn("attribute_symbol_id", F.lit(None).cast("long"))


def _diagnostics(symbols: DataFrame) -> DataFrame:
    bare = symbols.filter("kind_name in ('method', 'function') and xml_summary is null and file_id is not null")
    return bare.select(
        "scope", "id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("symbol_id"), "file_id", (F.col("id") % 4).cast("int").alias("severity"),
        F.concat(F.lit("CG"), F.lpad((F.col("id") % 5).cast("string"), 4, "0")).alias("code"), F.concat(F.lit("undocumented "), "name").alias("message"), F.col("start_line").alias("line"), F.col("start_col").alias("col"),
    )


def _history(symbols: DataFrame) -> DataFrame:
    authors = F.array(*[F.lit(a) for a in AUTHORS])
    return symbols.filter("id % 3 = 0 and added_at is not null").select(
        "scope", F.col("id").alias("symbol_id"), F.md5("canonical_key").alias("last_commit_sha"), F.get(authors, (F.col("id") % 5).cast("int")).alias("last_author"),
        F.unix_millis(F.col("added_at").cast("timestamp")).alias("last_authored_at"), (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), F.lit(None).cast("binary").alias("blamed_content_sha"),
    )


AUTHORS = ("ana", "bo", "cy", "dee", "eli")


def from_driver(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Project the bundle from the driver's tables (session time zone UTC)."""
    files = _live_files(read_table(spark, sf_dir, "files"))
    symbols = _live_symbols(read_table(spark, sf_dir, "symbols"), read_table(spark, sf_dir, "shared_symbols"))
    rows = _edge_rows(read_table(spark, sf_dir, "edges"))
    refs = read_table(spark, sf_dir, "refs").filter("symbol_id is not null and file_id is not null")
    edge = ["scope", "src", "dst", "kind_name"]
    return empty_tables(
        spark,
        files=files,
        symbols=symbols.drop("added_at"),
        refs=refs.select(F.col("scope_id").alias("scope"), "id", "symbol_id", "file_id", "line", "col", "kind").distinct(),
        edges=rows.groupBy(*edge).agg(F.min("payload").alias("payload")),
        edge_evidence=_evidence(rows, symbols, files),
        annotations=_annotations(symbols),
        diagnostics=_diagnostics(symbols),
        symbol_history=_history(symbols),
        embeddings=None,
        scopes=read_table(spark, sf_dir, "scopes"),
    )


class StoredTables:
    """A bundle whose tables are written to a folder at their first use and read from there after;
    answers as ``GraphTables`` does."""

    def __init__(self, spark: SparkSession, folder: str, source: GraphTables):
        self._spark, self._folder, self._source = spark, folder, source
        self._read: dict[str, DataFrame] = {}
        self._kept: dict[str, object] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self._load(name)
        return self._read[name]

    def _load(self, name: str) -> DataFrame:
        path = self._spark._jvm.org.apache.hadoop.fs.Path
        target, fresh = path(f"{self._folder}/{name}"), path(f"{self._folder}/.{name}-{uuid.uuid4().hex}")
        fs = target.getFileSystem(self._spark._jsc.hadoopConfiguration())
        frame = getattr(self._source, name)
        if not fs.exists(target):
            frame.write.parquet(fresh.toString())
            if not fs.rename(fresh, target) and not fs.exists(target):
                raise RuntimeError(f"{target} couldn't be written")
        return self._spark.read.schema(frame.schema).parquet(target.toString())

    def once(self, name: str, find):
        """A small fact about the tables that is found once."""
        if name not in self._kept:
            self._kept[name] = find()
        return self._kept[name]

    def _bundle(self) -> GraphTables:
        return GraphTables(**{n: getattr(self, n) for n in SCHEMAS})

    def with_tables(self, **changed: DataFrame) -> GraphTables:
        return self._bundle().with_tables(**changed)

    def restrict(self, scope_ids) -> GraphTables:
        return self._bundle().restrict(scope_ids)


_STORED: dict[str, StoredTables] = {}
SOURCES = ("files", "symbols", "shared_symbols", "edges", "refs", "scopes")


def stored(spark: SparkSession, sf_dir: str) -> StoredTables:
    """The projection of the driver's tables, each of its tables written once to the shared folder and
    read from there by all questions of the session.  Files that changed make a new projection."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    seen = [shared_folder(spark), sf_dir]
    for name in SOURCES:
        at = path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(at):
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    key = hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]
    if key not in _STORED or _STORED[key]._spark is not spark:
        _STORED[key] = StoredTables(spark, f"{seen[0]}/model-{key}", from_driver(spark, sf_dir))
    return _STORED[key]


#: The same projection for the SQL side, as common table expressions.
PROJECTION_SQL = """
g_files AS (
  SELECT scope_id AS scope, id, arg_max(path, last_indexed_at) AS path, arg_max(content_sha256, last_indexed_at) AS content_sha256, max(last_indexed_at) AS last_indexed_at, arg_max(is_generated, last_indexed_at) AS is_generated
  FROM files WHERE deleted_at IS NULL GROUP BY scope_id, id
), g_all AS (
  SELECT scope_id AS scope, id, canonical_key, name, fqn, replace(lower(trim(kind_name)), '_', '-') AS kind_name, file_id, start_line, start_col, end_line, end_col, signature, container_id, modifiers, accessibility, xml_summary, test_framework, added_at
  FROM symbols WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY scope_id, id ORDER BY added_at DESC NULLS LAST) = 1
  UNION ALL SELECT 'shared', id, canonical_key, name, fqn, kind_name, NULL, NULL, NULL, NULL, NULL, signature, NULL, NULL, accessibility, xml_summary, NULL, NULL FROM shared_symbols
), g_symbols AS (SELECT * EXCLUDE (added_at) FROM g_all),
g_refs AS (SELECT DISTINCT scope_id AS scope, id, symbol_id, file_id, line, col, kind FROM refs WHERE symbol_id IS NOT NULL AND file_id IS NOT NULL),
g_rows AS (SELECT DISTINCT scope_id AS scope, src, dst, replace(lower(trim(kind_name)), '_', '-') AS kind_name, nullif(payload, '') AS payload FROM edges),
g_edges AS (SELECT scope, src, dst, kind_name, min(payload) AS payload FROM g_rows GROUP BY ALL),
g_evidence AS (
  SELECT r.scope, r.id, r.src, r.dst, r.kind_name, s.file_id AS producing_file_id, f.path AS file_path, (s.start_line + r.dst % 7)::INTEGER AS start_line, 1 AS start_col, (s.start_line + r.dst % 7)::INTEGER AS end_line, 9 AS end_col,
    ((r.src + r.dst) % 3)::INTEGER AS confidence, CASE WHEN r.src % 2 = 0 THEN 'compiler' ELSE 'syntax' END AS producer, coalesce(r.payload, '') AS payload
  FROM (SELECT *, row_number() OVER (PARTITION BY scope, src, dst, kind_name ORDER BY payload NULLS FIRST) AS id FROM g_rows WHERE (src + dst) % 5 <> 0) r
  JOIN g_symbols s ON s.scope = r.scope AND s.id = r.src JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id
), g_annotations AS (
  SELECT scope, id * 10 + 1 AS id, id AS symbol_id, upper(modifiers[1]) || modifiers[2:] AS name, 'System.' || upper(modifiers[1]) || modifiers[2:] || 'Attribute' AS full_name, split_part(canonical_key, ':', 1) || '-attribute' AS flavor,
    '["' || kind_name || '",{"level":' || accessibility || '}]' AS args_json FROM g_symbols WHERE modifiers IS NOT NULL
  UNION ALL SELECT scope, id * 10 + 2, id, 'Test', 'Test.Framework', 'test', '["' || test_framework || '"]' FROM g_symbols WHERE test_framework IS NOT NULL
), g_diagnostics AS (
  SELECT scope, id, CASE WHEN id % 10 <> 0 THEN id END AS symbol_id, file_id, (id % 4)::INTEGER AS severity, 'CG' || lpad((id % 5)::VARCHAR, 4, '0') AS code, 'undocumented ' || name AS message, start_line AS line, start_col AS col
  FROM g_symbols WHERE kind_name IN ('method', 'function') AND xml_summary IS NULL AND file_id IS NOT NULL
), g_history AS (
  SELECT scope, id AS symbol_id, md5(canonical_key) AS last_commit_sha, ['ana', 'bo', 'cy', 'dee', 'eli'][(id % 5)::INTEGER + 1] AS last_author, epoch_us(added_at) // 1000 AS last_authored_at, end_line - start_line + 1 AS line_count
  FROM g_all WHERE id % 3 = 0 AND added_at IS NOT NULL
)"""
