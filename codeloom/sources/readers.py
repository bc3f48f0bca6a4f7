"""Readers of raw inputs: source trees, blame output, PE export tables, scope files, XAML, vectors."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and endings that are never read (fixed values).
PRIVATE_FOLDERS = ("bin", "obj", ".vs", "Debug", "Release", "Images", "PatientData", "Database", "Logs", ".git", "node_modules")
#: The engine's own data.
OWN_FOLDERS = (".codeloom",)
PRIVATE_ENDINGS = (".dcm", ".jpg", ".jpeg", ".png")
#: Files of a tree that one walk takes.
WALK_FILES = 50_000


def allowed_path(column: str = "path", more: tuple[str, ...] = OWN_FOLDERS) -> Column:
    """Paths outside private folders (and ``more`` folders) and without private endings."""
    folders = r"(?i)(^|[/\\])(" + "|".join(map(re.escape, (*PRIVATE_FOLDERS, *more))) + r")([/\\]|$)"
    endings = r"(?i)(" + "|".join(map(re.escape, PRIVATE_ENDINGS)) + r")$"
    return ~F.col(column).rlike(folders) & ~F.col(column).rlike(endings)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read files in pieces and append their SHA-256."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for uri in batch["uri"].to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(path) as stream:
                while piece := stream.read(1 << 20):
                    digest.update(piece)
            out.append(digest.digest())
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("scope", "path", "size", "modified")], pa.array(out, pa.binary())], ["scope", "path", "size", "modified", "content_sha256"])


@dataclass(frozen=True)
class Walk:
    """files: scope, path, size, modified, content_sha256.  A partial walk met more files than it may
    take, so that a file it lacks isn't known to be gone."""

    files: DataFrame
    partial: bool


def walk(spark: SparkSession, root: str, scope: str, pattern: str = "*", most: int = WALK_FILES) -> Walk:
    """Walk a tree.  Paths are judged before any content is read: the listing asks for no content, and
    only allowed files are opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = rows.select(F.lit(scope).alias("scope"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.regexp_replace("path", "^file:/+", "file:///").alias("uri"))
    inside = F.substring("path", F.length(F.lit(root.rstrip("/"))) + 1, 1 << 20) if root.startswith("/") else F.col("path")
    allowed = rows.withColumn("_inside", inside).filter(allowed_path("_inside")).drop("_inside")
    partial = allowed.limit(most + 1).count() > most
    few = allowed.orderBy("path").limit(most) if partial else allowed
    return Walk(few.mapInArrow(_digests, "scope string, path string, size long, modified timestamp, content_sha256 binary"), partial)


def walk_tree(spark: SparkSession, root: str, scope: str, pattern: str = "*") -> DataFrame:
    """(scope, path, size, modified, content_sha256) of all allowed files of a tree."""
    return walk(spark, root, scope, pattern, 1 << 30).files


_BLAME_HEAD = re.compile(r"^([0-9a-f]{40}) (\d+) (\d+)(?: \d+)?$")


def parse_blame(texts: DataFrame) -> DataFrame:
    """(scope, file_id, line, sha, author, authored_at) from line-porcelain output, one text per
    file (scope, file_id, text).  Damaged blocks are skipped."""

    def one(text: str):
        sha = line = author = at = None
        for row in (text or "").splitlines():
            if head := _BLAME_HEAD.match(row):
                sha, line, author, at = head[1], int(head[3]), None, None
            elif row.startswith("author "):
                author = row[7:]
            elif row.startswith("author-time ") and row[12:].strip().lstrip("-").isdigit():
                at = int(row[12:]) * 1000
            elif row.startswith("\t") and sha and at is not None:
                yield line, sha, author, at
                sha = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, f, *x) for s, f, t in zip(b["scope"].to_pylist(), b["file_id"].to_pylist(), b["text"].to_pylist()) for x in one(t)]
            names = ["scope", "file_id", "line", "sha", "author", "authored_at"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return texts.select("scope", "file_id", "text").mapInArrow(run, "scope string, file_id long, line int, sha string, author string, authored_at long")


def pe_exports(content: bytes | None, most: int = 65_536) -> list[str]:
    """Exported names of a portable executable; empty for anything else or damaged tables.  A table of
    more than ``most`` names is an OverflowError."""
    try:
        if content is None or content[:2] != b"MZ":
            return []
        pe = struct.unpack_from("<I", content, 60)[0]
        if content[pe : pe + 4] != b"PE\0\0":
            return []
        sections, optional = struct.unpack_from("<H", content, pe + 6)[0], struct.unpack_from("<H", content, pe + 20)[0]
        head = pe + 24
        directory = head + (112 if struct.unpack_from("<H", content, head)[0] == 0x20B else 96)
        rva = struct.unpack_from("<I", content, directory)[0]
        table = [struct.unpack_from("<8sIIII", content, head + optional + 40 * k)[1:] for k in range(sections)]

        def at(address: int) -> int:
            for size, start, raw_size, raw in table:
                if start <= address < start + max(size, raw_size):
                    return address - start + raw
            raise ValueError("outside of all sections")

        if not rva:
            return []
        count, names = struct.unpack_from("<I", content, at(rva) + 24)[0], struct.unpack_from("<I", content, at(rva) + 32)[0]
        if count > most:
            raise OverflowError(f"more than {most} exported names")
        out = []
        for k in range(count):
            start = at(struct.unpack_from("<I", content, at(names) + 4 * k)[0])
            out.append(content[start : content.index(b"\0", start)].decode("ascii"))
        return out
    except (struct.error, ValueError, UnicodeDecodeError):
        return []


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    """(path, export_name, problem) of all libraries below a folder; a library with too many names is
    one row with a problem and no name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                try:
                    rows += [(path, name, None) for name in pe_exports(content)]
                except OverflowError as problem:
                    rows.append((path, None, str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[], [], []])], ["path", "export_name", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInArrow(run, "path string, export_name string, problem string")


def read_scope_file(spark: SparkSession, path: str) -> DataFrame:
    """Scopes of a configuration file: id, name, root, isolated, problem (null if valid)."""
    scope = "array<struct<id:string,name:string,root:string,isolated:boolean>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<scopes:{scope}>").alias("c"))
    rows = raw.select(F.explode("c.scopes").alias("s")).select("s.id", F.coalesce("s.name", "s.id").alias("name"), "s.root", F.coalesce("s.isolated", F.lit(False)).cast("int").alias("isolated"))
    problem = F.when(F.col("id").isNull() | ~F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"), "bad id").when(F.col("root").isNull(), "no root")
    return rows.withColumn("problem", problem)


_MARKUP = re.compile(r"^\{(\w+)\s*(.*)\}$", re.S)


def parse_markup_extension(text: str | None) -> tuple[str, dict[str, str]] | None:
    """('Binding', {'path': ..., 'mode': ...}) of a markup extension; None for plain text."""
    found = _MARKUP.match((text or "").strip())
    if not found:
        return None
    values: dict[str, str] = {}
    depth, part, parts = 0, "", []
    for ch in found[2]:
        depth += (ch == "{") - (ch == "}")
        if ch == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += ch
    for k, piece in enumerate([*parts, part]):
        if not piece.strip():
            continue
        name, sign, value = piece.partition("=")
        if sign:
            values[name.strip().lower()] = value.strip()
        elif k == 0:
            values["path"] = piece.strip()
    return found[1], values


def read_xaml(texts: DataFrame) -> DataFrame:
    """(scope, path, element, name, attribute, extension, payload) of the bindings and resources that
    XAML texts (scope, path, text) use; texts that aren't well formed give no row."""

    def one(text):
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return
        for node in root.iter():
            tag = node.tag.rsplit("}", 1)[-1]
            name = next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == "Name"), None)
            for key, value in node.attrib.items():
                if parsed := parse_markup_extension(value):
                    yield tag, name, key.rsplit("}", 1)[-1], parsed[0], list(parsed[1].items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string())]
        names = ["scope", "path", "element", "name", "attribute", "extension", "payload"]
        for b in batches:
            rows = [(s, p, *x) for s, p, t in zip(b["scope"].to_pylist(), b["path"].to_pylist(), b["text"].to_pylist()) for x in one(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return texts.select("scope", "path", "text").mapInArrow(run, "scope string, path string, element string, name string, attribute string, extension string, payload map<string,string>")


def mock_vector(text: str, dimension: int) -> list[float]:
    """A deterministic unit vector: each word adds signs at places that its digest names."""
    values = [0.0] * dimension
    for word in re.findall(r"\w+", text.lower()):
        digest = hashlib.sha256(word.encode()).digest()
        for k in range(0, 30, 5):
            values[int.from_bytes(digest[k : k + 4], "little") % dimension] += 1.0 if digest[k + 4] & 1 else -1.0
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values] if norm else values


def embed_texts(texts: DataFrame, dimension: int = 64) -> DataFrame:
    """Adds a column embedding to rows (scope, symbol_id, text, content_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("embedding", pa.array([mock_vector(t or "", dimension) for t in b["text"].to_pylist()], pa.list_(pa.float32())))

    kept = texts.select("scope", "symbol_id", "text", "content_hash")
    return kept.mapInArrow(run, f"scope string, symbol_id long, text string, content_hash {kept.schema['content_hash'].dataType.simpleString()}, embedding array<float>")
