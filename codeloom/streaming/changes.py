"""Streams of file changes: debounced batches, fact merges, embeddings, blame, and live orphans."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.aggregate import blame_spans
from codeloom.operators.merge import SnapshotStore, scope_diff, to_embed, upsert_embeddings, upsert_history
from codeloom.session import collect_bounded
from codeloom.sources.readers import read_scope_file
from codeloom.tables import GraphTables

#: Scopes of a configuration file.
MOST_SCOPES = 100_000
CHANGES = "scope string, path string, ts timestamp, reason string"
HEAD = "GitHeadChanged"


def read_changes(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Changes from JSON lines that appear in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def debounce(changes: DataFrame, gap: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One batch per scope and quiet gap, head moves apart from file changes: (scope, reason,
    started, ended, paths).  Works on streams (append mode, once the watermark has passed) and on
    static frames alike.  Paths of one burst are a set; they are as many as its files."""
    rows = changes.withWatermark("ts", late).withColumn("reason", F.when(F.col("reason") == HEAD, HEAD).otherwise("FileSystemEvent"))
    sets = rows.groupBy("scope", "reason", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return sets.select("scope", "reason", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")


def hourly_changes(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes per scope and hour of the event, however late within the watermark."""
    windows = changes.withWatermark("ts", late).groupBy("scope", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("path").alias("n_paths"))
    return windows.select("scope", F.col("w.start").alias("hour"), "n", "n_paths")


def apply_stream(changes: DataFrame, store: SnapshotStore, merge: Callable[[GraphTables, DataFrame], GraphTables], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge each micro-batch into the store.  The store's pointer remembers the number of the last
    batch of this stream (named by its checkpoint folder), so a batch that is delivered again, also
    after the driver was lost, isn't merged twice."""

    def one(batch: DataFrame, number: int) -> None:
        if number > store.last_batch(checkpoint) and not batch.isEmpty():
            store.publish(merge(store.read(), batch), batch=(checkpoint, number))

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def with_retry(run: Callable[[], object], waits=(1.0, 5.0, 25.0), sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds, waiting longer each time; the last failure is raised."""
    for wait in waits:
        try:
            return run()
        except Exception:  # noqa: BLE001
            sleep(wait)
    return run()


def embed_batch(t: GraphTables, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], model_version: str) -> GraphTables:
    """Vectors for texts that are new or changed (embed: adds a column embedding)."""
    stale = to_embed(texts, t.embeddings, model_version)
    fresh = embed(stale).withColumn("model_version", F.lit(model_version))
    return t.with_tables(embeddings=upsert_embeddings(t.embeddings, fresh))


def blame_batch(t: GraphTables, lines: DataFrame, contents: DataFrame) -> GraphTables:
    """History of the symbols in files whose content changed since they were blamed (contents:
    scope, file_id, content_sha256)."""
    known = t.symbol_history.join(t.symbols.select("scope", F.col("id").alias("symbol_id"), "file_id"), ["scope", "symbol_id"]).select("scope", "file_id", F.col("blamed_content_sha").alias("content_sha256")).distinct()
    stale = contents.join(known, ["scope", "file_id", "content_sha256"], "left_anti")
    spans = t.symbols.join(stale.select("scope", "file_id"), ["scope", "file_id"], "left_semi").select("scope", F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    rows = blame_spans(spans, lines)
    sha = t.symbols.select("scope", F.col("id").alias("symbol_id"), "file_id").join(stale.select("scope", "file_id", F.col("content_sha256").alias("blamed_content_sha")), ["scope", "file_id"]).drop("file_id")
    return t.with_tables(symbol_history=upsert_history(t, rows.join(sha, ["scope", "symbol_id"])))


def watch_scopes(spark: SparkSession, path: str, current: DataFrame, default: DataFrame, polls: Iterable[object]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Watch a scope file: for each poll at which it appeared, changed or went away (and at the first),
    the scopes it says (id, name, root, isolated) and their differences from those before, if there are
    any.  A file that can't be read as scopes, or has a scope with a problem, changes nothing until the
    next valid one; without a file the default scopes hold."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    columns, last = ["id", "name", "root", "isolated"], None
    for _ in polls:
        status = fs.getFileStatus(at) if fs.exists(at) else None
        seen = (status.getModificationTime(), status.getLen()) if status else ()
        if seen == last:
            continue
        last = seen
        found = read_scope_file(spark, path) if status else default.withColumn("problem", F.lit(None).cast("string"))
        rows = collect_bounded(found, MOST_SCOPES)  # a configuration file's scopes
        if status and (not rows or any(r["problem"] for r in rows)):
            continue
        fresh = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "id string, name string, root string, isolated int")
        changes = scope_diff(current.select(*columns), fresh)
        if not changes.isEmpty():
            current = fresh
            yield fresh, changes
