"""Encoding of whole texts with a public byte-level BPE by content-defined chunk reuse.

A hash that rolls over every window of eight bytes proposes cuts, so equal passages get equal chunks
wherever they stand.  Chunk hashes are counted over the whole corpus (hashes are shuffled, not texts);
a chunk that occurs more than once is encoded once, into a dictionary.  A text is then a row of
dictionary chunks and of the runs between them, which are encoded where they stand; a text without a
shared chunk is one run.

Two neighbours may encode otherwise together than apart, so every join is repaired: the bytes around
it are encoded again, from a place in the left part that no right context can change to a place in
the right part, further to the right each time, until the new ids agree there with the right part's
own (or the right part is used up).  Why that is exact: the pre-tokenizer matches from left to right,
and a match depends on the text from its start on alone.  All but the last piece of a left part are
therefore pieces of the whole text too, and once a match starts where one of the right part's started,
all that follow are the same.  A token that begins with a blank before a visible ASCII character
always starts a piece, since no piece has a blank inside; such tokens are the places.  Merges never
leave a piece.  Hence the ids equal those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that belongs to the ranks (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: A cut is proposed for so many bytes on average (a power of two), the next one LEAST_BYTES later at
#: the earliest; longer runs without a cut are one chunk.
CHUNK_BYTES = 256
LEAST_BYTES = 64
#: Bytes of text that the broadcast dictionary holds at most.  Where the shared chunks have more, it
#: takes those that occur most often; the others are encoded where they stand, with the same ids.
DICTIONARY_BYTES = 32 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_table(path: str) -> tuple[list[bytes], list[bool]]:
    """Bytes of every token, and whether it begins with a blank before a visible ASCII character."""
    encoding = load_encoding(path)
    table = [encoding.decode_single_token_bytes(k) for k in range(encoding.n_vocab)]
    return table, [len(b) > 1 and b[0] == 32 and 32 < b[1] < 127 for b in table]


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(all texts one after the other, offsets of each); null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = bytes(memoryview(buffers[2])[offsets[0] : offsets[-1]]) if len(texts) and offsets[-1] > offsets[0] else b""
    return whole, offsets - offsets[0]


def chunk_starts(whole: bytes, offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_BYTES) -> list[int]:
    """Starts of all chunks of the texts whole[offsets[k]:offsets[k+1]], in order; each text starts
    one, and no cut falls inside a character."""
    data = np.frombuffer(whole, np.uint8)
    bounds = np.unique(offsets[:-1][offsets[:-1] < len(whole)])
    n = len(data) - 7
    if n <= 0:
        return bounds.tolist()
    windows = np.ndarray((n,), "<u8", buffer=data, strides=(1,))
    bits = np.uint64(64 - (chunk_bytes.bit_length() - 1))
    wanted = np.flatnonzero((windows * _MULTIPLIER) >> bits == 0) + 8
    for _ in range(3):  # on to the next character
        wanted = wanted[wanted < len(data)]
        wanted = wanted + (data[wanted] & 0xC0 == 0x80)
    wanted = wanted[wanted < len(data)]
    since = wanted - bounds[np.searchsorted(bounds, wanted, "right") - 1]  # bytes since the text's start
    out: list[int] = []
    at, ends, last = iter(wanted[since >= least].tolist()), bounds.tolist(), -least
    cut = next(at, None)
    for start, stop in zip(ends, [*ends[1:], len(whole)]):
        out.append(start)
        last = start
        while cut is not None and cut < stop:
            if cut - last >= least:
                out.append(cut)
                last = cut
            cut = next(at, None)
    return out


class Joiner:
    """Puts the parts of one text together; ``ids`` are those of the text so far."""

    def __init__(self, path: str):
        self.encode = load_encoding(path).encode_ordinary
        self.bytes, self.opens = token_table(path)
        self.ids: list[int] = []
        self.safe = 0  # ids[:safe] can't change, whatever follows
        self.pending = b""  # parts without a place to agree, to be encoded with what follows
        self.joins = self.repeated = 0

    def _settle(self) -> None:
        for k in range(len(self.ids) - 1, self.safe, -1):
            if self.opens[self.ids[k]]:
                self.safe = k
                return

    def _again(self, text: bytes) -> list[int]:
        self.repeated += len(text)
        return self.encode(text.decode())

    def add(self, part: bytes, ids: list[int]) -> None:
        if not self.ids and not self.pending:
            self.ids = list(ids)
            self._settle()
            return
        self.joins += 1
        open_ids, at, places = self.opens, 0, []
        left = None
        for k, token in enumerate(ids):
            if open_ids[token]:
                places.append((k, at))
                if len(places) > 1:
                    left = self._before() if left is None else left
                    if self._agree(left, part, ids, *places[-2], stop=at):
                        return
            at += len(self.bytes[token])
        if not places:
            self.pending += part
            return
        left = self._before() if left is None else left
        if not self._agree(left, part, ids, *places[-1], stop=len(part)):
            self.ids[self.safe :] = self._again(left + part)
            self.pending = b""
            self._settle()

    def _before(self) -> bytes:
        return b"".join(map(self.bytes.__getitem__, self.ids[self.safe :])) + self.pending

    def _agree(self, left: bytes, part: bytes, ids: list[int], k: int, at: int, stop: int) -> bool:
        """Encode left + part[:stop] again; if a piece starts at the part's k-th token as it does in
        the part, the part's other ids follow."""
        again = self._again(left + part[:stop])
        spot, goal = 0, len(left) + at
        for n, token in enumerate(again):
            if spot >= goal:
                break
            spot += len(self.bytes[token])
        else:
            return False
        if spot != goal or again[n] != ids[k]:
            return False
        self.ids[self.safe :] = again[:n] + ids[k:]
        self.pending = b""
        self._settle()
        return True

    def finish(self) -> list[int]:
        if self.pending:
            self.ids[self.safe :] = self._again(self._before())
            self.pending = b""
        return self.ids


class ChunkEncoder:
    """Encodes batches of texts with a dictionary of chunks (their bytes to the bytes of their ids)."""

    def __init__(self, path: str, shared: dict[bytes, bytes] | None = None, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_BYTES):
        self.path, self.shared, self.chunk_bytes, self.least = path, shared or {}, chunk_bytes, least
        self.plain = load_encoding(path).encode_ordinary
        self.encoded = self.joins = 0

    def _run(self, text: bytes) -> list[int]:
        self.encoded += len(text)
        return self.plain(text.decode())

    def _one(self, whole: bytes, cuts: list[int]) -> list[int]:
        """Ids of one text from its cuts, both ends among them.  Bytes that are no valid text stand for the
        replacement character; a text with such bytes is encoded in one piece."""
        try:
            return self._parts(whole, cuts)
        except UnicodeDecodeError:
            return self.plain(whole[cuts[0] : cuts[-1]].decode("utf-8", "replace"))

    def _parts(self, whole: bytes, cuts: list[int]) -> list[int]:
        get = self.shared.get
        known = [get(whole[a:z]) for a, z in zip(cuts, cuts[1:])]
        if not any(x is not None for x in known):
            return self._run(whole[cuts[0] : cuts[-1]])
        joiner, start = Joiner(self.path), None
        for k, ids in enumerate(known):
            if ids is None:
                start = cuts[k] if start is None else start
                continue
            if start is not None:
                joiner.add(whole[start : cuts[k]], self._run(whole[start : cuts[k]]))
                start = None
            joiner.add(whole[cuts[k] : cuts[k + 1]], np.frombuffer(ids, np.int32).tolist())
        if start is not None:
            joiner.add(whole[start : cuts[-1]], self._run(whole[start : cuts[-1]]))
        done = joiner.finish()
        self.encoded += joiner.repeated
        self.joins += joiner.joins
        return done

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; offsets of each text in them).  Null and empty
        texts have no ids."""
        whole, offsets = text_bytes(texts)
        starts = chunk_starts(whole, offsets, self.chunk_bytes, self.least) if self.shared else np.unique(offsets[:-1]).tolist()
        starts.append(len(whole))
        first = np.searchsorted(starts, offsets).tolist()
        ends, parts = np.zeros(len(offsets), np.int64), []
        for k, (a, z) in enumerate(zip(first, first[1:])):
            ids = self._one(whole, starts[a : z + 1]) if z > a else ()
            parts.append(np.array(ids, np.int32))
            ends[k + 1] = ends[k] + len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), ends

    def lengths(self, texts: pa.Array) -> list[int]:
        """Numbers of ids, by plain encoding."""
        return [len(self.plain(t.decode("utf-8", "replace"))) if t else 0 for t in texts.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have ``most_bytes`` (a longer text stands alone)."""
    sizes = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[dict[bytes, int]]:
    """Chunks of each slice with their numbers of occurrences."""
    for whole_batch in batches:
        for batch in slices(whole_batch, "text"):
            whole, offsets = text_bytes(batch["text"])
            starts = chunk_starts(whole, offsets, chunk_bytes)
            seen: dict[bytes, int] = {}
            for a, z in zip(starts, [*starts[1:], len(whole)]):
                chunk = whole[a:z]
                seen[chunk] = seen.get(chunk, 0) + 1
            yield seen


def _signed(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def count_chunks(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(hash, size, n): chunks that occur more than once in the corpus.  Each task sends a chunk's hash
    once per slice of its texts, so a chunk that every text holds is no crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_pydict({"hash": pa.array([_signed(c) for c in seen], pa.int64()), "size": pa.array([len(c) for c in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = documents.select("text").mapInArrow(run, "hash long, size long, n long")
    return rows.groupBy("hash").agg(F.max("size").alias("size"), F.sum("n").alias("n")).filter("n > 1")


def build_dictionary(documents: DataFrame, path: str = TOKENIZER, chunk_bytes: int = CHUNK_BYTES, most_bytes: int = DICTIONARY_BYTES) -> dict[bytes, bytes]:
    """Ids of the corpus's shared chunks, each encoded once.  The dictionary holds ``most_bytes`` of
    text at most: where there are more, chunks that occur more often come first (of a last number of
    occurrences that doesn't fit as a whole, none).  It is collected, which that bound allows."""
    from codeloom.session import collect_bounded, cut

    counted = cut(count_chunks(documents, chunk_bytes))
    often = F.least(F.col("n"), F.lit(100_000)).alias("often")
    sizes = sorted(collect_bounded(counted.groupBy(often).agg(F.sum("size").alias("size")), 100_000), reverse=True)
    room, least = most_bytes, None
    for row in sizes:
        room -= row["size"]
        if room < 0:
            break
        least = row["often"]
    if least is None:
        return {}
    # each chunk has a byte at least, so there are at most ``most_bytes`` hashes
    hashes = np.sort(counted.filter(F.col("n") >= least).select("hash").toArrow()["hash"].to_numpy())
    wanted = documents.sparkSession.sparkContext.broadcast(hashes)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(wanted.value.tolist())
        sent: set[int] = set()
        for seen in _chunks(batches, chunk_bytes):
            chosen = {h: c for c in seen if (h := _signed(c)) in known and h not in sent}
            sent.update(chosen)
            yield pa.RecordBatch.from_pydict({"hash": pa.array(list(chosen), pa.int64()), "chunk": pa.array(list(chosen.values()), pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = load_encoding(path).encode_ordinary
        for batch in batches:
            texts = {c: t for c in batch["chunk"].to_pylist() if "\ufffd" not in (t := c.decode("utf-8", "replace"))}  # valid ones
            ids = [np.array(plain(t), np.int32).tobytes() for t in texts.values()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(texts), pa.binary()), "ids": pa.array(ids, pa.binary())})

    chunks = documents.select("text").mapInArrow(pick, "hash long, chunk binary").groupBy("hash").agg(F.min("chunk").alias("chunk"))
    table = chunks.select("chunk").mapInArrow(encode, "chunk binary, ids binary").toArrow()
    return dict(zip(table["chunk"].to_pylist(), table["ids"].to_pylist()))


def encode_documents(documents: DataFrame, path: str = TOKENIZER, chunk_bytes: int = CHUNK_BYTES, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, ids): the whole text of every row as token ids without special tokens.

    Null and empty texts give an empty list, blank texts their ids; names of special tokens in a
    text are ordinary text; repeated rows and null doc_ids stay as they are; extra columns are not
    read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(build_dictionary(documents, path, chunk_bytes, most_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, shared.value, chunk_bytes)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, ends = encoder.encode(batch["text"])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def reuse_report(documents: DataFrame, path: str = TOKENIZER, chunk_bytes: int = CHUNK_BYTES, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """One row: bytes of the corpus, of the dictionary, and those that were encoded beside it (runs and
    joins), number of joins."""
    found = build_dictionary(documents, path, chunk_bytes, most_bytes)
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = ChunkEncoder(path, shared.value, chunk_bytes), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                total += len(text_bytes(batch["text"])[0])
                encoder.encode(batch["text"])
        yield pa.RecordBatch.from_pydict({"corpus_bytes": [total], "encoded_bytes": [encoder.encoded], "joins": [encoder.joins]})

    sums = documents.select("text").mapInArrow(run, "corpus_bytes long, encoded_bytes long, joins long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("corpus_bytes", "encoded_bytes", "joins")])
    return sums.withColumn("dictionary_bytes", F.lit(sum(map(len, found))).cast("long"))
