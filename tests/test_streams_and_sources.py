"""Streams against their batch form, and readers on small inputs."""

import hashlib
import json
import struct

from pyspark.sql import functions as F

from codeloom.operators import merge
from codeloom.sources import readers
from codeloom.streaming import changes
from codeloom.tables import SCHEMAS, empty_tables

ROWS = [("a", "/x", "2025-01-01T00:00:00.000Z", "FileSystemEvent"), ("a", "/x", "2025-01-01T00:00:00.100Z", "FileSystemEvent"), ("a", "/y", "2025-01-01T00:00:00.250Z", "FileSystemEvent"), ("a", "/z", "2025-01-01T00:00:02.000Z", "FileSystemEvent"), ("a", ".git/HEAD", "2025-01-01T00:00:00.050Z", "GitHeadChanged"), ("a", "/end", "2025-01-01T01:00:00.000Z", "FileSystemEvent")]


def write_rows(folder, rows):
    folder.mkdir(exist_ok=True)
    for k, r in enumerate(rows):
        (folder / f"{k}.json").write_text(json.dumps(dict(zip(("scope", "path", "ts", "reason"), r))))


def test_debounced_stream_is_the_batch(spark, tmp_path):
    write_rows(tmp_path / "in", ROWS)
    static = spark.read.schema(changes.CHANGES).json(str(tmp_path / "in"))
    batch = {(r.reason, tuple(r.paths)) for r in changes.debounce(static).collect()}
    assert batch == {("FileSystemEvent", ("/x", "/y")), ("FileSystemEvent", ("/z",)), ("FileSystemEvent", ("/end",)), ("GitHeadChanged", (".git/HEAD",))}
    stream = changes.debounce(changes.read_changes(spark, str(tmp_path / "in")))
    run = stream.writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.reason, tuple(r.paths)) for r in spark.table("debounced").collect()}
    assert got == batch - {("FileSystemEvent", ("/end",))}  # the last session is still open


def test_batches_are_merged_into_versions(spark, tmp_path):
    write_rows(tmp_path / "in", ROWS[:3])
    store = merge.SnapshotStore(spark, str(tmp_path / "graph"))
    store.publish(empty_tables(spark))

    def apply(t, batch):
        new = batch.select("scope", "path", F.lit(None).cast("binary").alias("content_sha256"), F.unix_millis("ts").alias("last_indexed_at"), F.lit(0).alias("is_generated"))
        return t.with_tables(files=merge.upsert_files(t.files, new))

    stream = changes.read_changes(spark, str(tmp_path / "in"), files_per_trigger=1)
    changes.apply_stream(stream, store, apply, str(tmp_path / "cp")).awaitTermination(240)
    assert store.current() == 4 and sorted(r.path for r in store.read().files.collect()) == ["/x", "/y"]
    assert store.last_batch(str(tmp_path / "cp")) == 2 and store.last_batch("other") == -1


def test_embedding_and_blame_batches(spark):
    symbols = spark.createDataFrame([("s", 1, "k", "n", "n", "method", 1, 1, 1, 3, 1, None, None, None, 1, "doc", None)], SCHEMAS["symbols"])
    t = empty_tables(spark, symbols=symbols)
    texts = spark.createDataFrame([("s", 1, "open the door", b"1")], "scope string, symbol_id long, text string, content_hash binary")
    once = changes.embed_batch(t, texts, readers.embed_texts, "m1")
    assert abs(sum(x * x for x in once.embeddings.first().embedding) - 1) < 1e-5
    assert merge.to_embed(texts, once.embeddings, "m1").count() == 0 and merge.to_embed(texts, once.embeddings, "m2").count() == 1
    lines = spark.createDataFrame([("s", 1, 2, "c", "ana", 9)], "scope string, file_id long, line int, sha string, author string, authored_at long")
    contents = spark.createDataFrame([("s", 1, b"7")], "scope string, file_id long, content_sha256 binary")
    blamed = changes.blame_batch(t, lines, contents)
    assert blamed.symbol_history.first().last_author == "ana"
    assert changes.blame_batch(blamed, lines.limit(0), contents).symbol_history.count() == 1


def test_blame_text(spark):
    text = "a" * 40 + " 1 1 1\nauthor Ana\nauthor-time 12\n\tint x;\n" + "b" * 40 + " 9 2\nauthor Bo\nauthor-time bad\n\ty\n"
    texts = spark.createDataFrame([("s", 1, text), ("s", 2, None)], "scope string, file_id long, text string")
    assert [(r.line, r.author, r.authored_at) for r in readers.parse_blame(texts).collect()] == [(1, "Ana", 12000)]


def portable_executable(names):
    head = 64
    optional = 112 + 16 * 8
    body = bytearray(4096)
    body[:2] = b"MZ"
    struct.pack_into("<I", body, 60, head)
    body[head : head + 4] = b"PE\0\0"
    struct.pack_into("<H", body, head + 6, 1)
    struct.pack_into("<H", body, head + 20, optional)
    struct.pack_into("<H", body, head + 24, 0x20B)
    struct.pack_into("<I", body, head + 24 + 112, 0x1000)
    struct.pack_into("<8sIIII", body, head + 24 + optional, b".edata", 2048, 0x1000, 2048, 1024)
    struct.pack_into("<I", body, 1024 + 24, len(names))
    struct.pack_into("<I", body, 1024 + 32, 0x1000 + 100)
    spot = 400
    for k, n in enumerate(names):
        struct.pack_into("<I", body, 1024 + 100 + 4 * k, 0x1000 + spot)
        body[1024 + spot : 1024 + spot + len(n) + 1] = n.encode() + b"\0"
        spot += len(n) + 1
    return bytes(body)


def test_export_tables(spark, tmp_path):
    (tmp_path / "a.dll").write_bytes(portable_executable(["Run", "Stop"]))
    (tmp_path / "b.dll").write_bytes(b"MZ broken")
    (tmp_path / "many.dll").write_bytes(portable_executable(["x"])[:1024] + struct.pack("<6I", *[0] * 6) + struct.pack("<I", 70_000) + b"\0" * 4096)
    rows = readers.read_exports(spark, str(tmp_path)).orderBy("export_name").collect()
    assert [r.export_name for r in rows] == [None, "Run", "Stop"] and "65536" in rows[0].problem
    assert readers.pe_exports(None) == [] and readers.pe_exports(portable_executable(["x"])[:1030]) == []


def test_tree_walk_leaves_private_paths(spark, tmp_path):
    for name in ("src/a.cs", ".git/config", "src/scan.DCM", "bin/x.cs", "debug/y.cs", "PatientData/z.cs", "src/b.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = readers.walk_tree(spark, str(tmp_path), "s").collect()
    assert [r.path.rsplit("/", 2)[1:] for r in rows] == [["src", "a.cs"]] and bytes(rows[0].content_sha256) == hashlib.sha256(b"x").digest()
    (tmp_path / "src/c.cs").write_text("y")
    (tmp_path / "src/secret.png").symlink_to("/nowhere")  # never opened
    cut = readers.walk(spark, str(tmp_path), "s", most=1)
    assert cut.partial and cut.files.count() == 1 and not readers.walk(spark, str(tmp_path), "s", pattern="*.cs", most=2).partial


def test_scope_file_and_xaml(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"scopes":[{"id":"a","root":"/a"},{"id":"B!","root":"/b","isolated":true},{"id":"c"}]}')
    assert [(r.id, r.isolated, r.problem) for r in readers.read_scope_file(spark, str(tmp_path / "c.json")).collect()] == [("a", 0, None), ("B!", 1, "bad id"), ("c", 0, "no root")]
    text = '<Grid xmlns:x="u"><Button x:Name="Go" Content="{Binding Path=A.B, Converter={StaticResource C, Key=1}, Mode=TwoWay}" Width="1"/></Grid>'
    rows = readers.read_xaml(spark.createDataFrame([("s", "/p", text), ("s", "/q", "<broken"), ("s", "/n", None)], "scope string, path string, text string")).collect()
    assert [(r.element, r.name, r.attribute, r.extension) for r in rows] == [("Button", "Go", "Content", "Binding")]
    assert rows[0].payload == {"path": "A.B", "converter": "{StaticResource C, Key=1}", "mode": "TwoWay"}


def test_retry_waits_longer():
    waited, calls = [], []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert changes.with_retry(run, sleep=waited.append) == "done" and waited == [1.0, 5.0]


def test_scope_file_is_watched(spark, tmp_path):
    shape = "id string, name string, root string, isolated int"
    default = spark.createDataFrame([("main", "main", "/m", 0)], shape)
    path, steps = tmp_path / "c.json", []

    def polls():
        yield 0  # no file: the default holds already
        path.write_text('{"scopes":[{"id":"a","root":"/a"}]}')
        yield 1
        yield 2  # nothing new
        path.write_text('{"scopes":[{"id":"B!","root":"/b"}] ')
        yield 3  # not valid
        path.write_text('{"scopes":[{"id":"a","root":"/other"},{"id":"b","root":"/b"}]}')
        yield 4
        path.unlink()
        yield 5

    for _, changes_ in changes.watch_scopes(spark, str(path), default, default, polls()):
        steps.append({(r.id, r.change) for r in changes_.collect()})
    assert steps == [{("main", "removed"), ("a", "added")}, {("a", "replaced"), ("b", "added")}, {("a", "removed"), ("b", "removed"), ("main", "added")}]
