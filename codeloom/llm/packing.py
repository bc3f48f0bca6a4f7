"""Filling fixed-capacity containers by bounded-space online packing.

Each task keeps at most ``windows`` open containers while it reads its documents: a document goes
into the open container that it fills best; if it fits into none, a new one is opened, and when all
are open the fullest is emitted first.  What is still open at the end of a task is a leftover, at
most ``windows`` per task whatever the number of documents.  Leftovers are merged as items in the
same way, a bounded number of tasks' leftovers at a time, until one task has seen the rest.

Only a document larger than the capacity is split: into full containers and a tail that is packed
like a document of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import TOKENIZER, ChunkEncoder, slices
from codeloom.operators.balance import partition_tokens
from codeloom.session import cut

CAPACITY = 2048
WINDOWS = 48
#: Tasks whose leftovers one merging task takes.
FAN_IN = 64
#: Tasks of one level at most (a container's id holds level, task and number).
TASKS = 1 << 22
_ROWS = "item long, piece int, n_pieces int, first_token long, n_tokens int, container long, left_over int"


class Packer:
    """Bounded-space best fit.  ``room`` is sorted, so the best container is found by bisection."""

    def __init__(self, capacity: int, windows: int, base: int):
        self.capacity, self.windows, self.next = capacity, windows, base
        self.room: list[tuple[int, int]] = []

    def full(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            if len(self.room) >= self.windows:
                self.room.pop(0)  # the fullest is emitted
            left, container = self.capacity, self.full()
        else:
            left, container = self.room.pop(at)
        if left > size:
            insort(self.room, (left - size, container))
        return container


def _packing(column: str, sizes: Callable, capacity: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, windows, TaskContext.get().partitionId() << 36)
        schema = pa.schema([("item", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int32()), ("container", pa.int64()), ("left_over", pa.int32())])
        for ids, counts in sizes(batches, column):
            rows = []
            for item, n in zip(ids, counts):
                if n <= 0:
                    continue
                pieces = -(-n // capacity)
                for k in range(n // capacity):
                    rows.append((item, k, pieces, k * capacity, capacity, packer.full(), None))
                if rest := n % capacity:
                    rows.append((item, pieces - 1, pieces, n - rest, rest, packer.place(rest), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)
        rows = [(None, None, None, None, None, container, capacity - room) for room, container in packer.room]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


def _token_sizes(path: str):
    def sizes(batches, column):
        encoder = ChunkEncoder(path)
        for whole in batches:
            for batch in slices(whole, column):
                yield batch["item"].to_pylist(), encoder.lengths(batch[column])

    return sizes


def _given_sizes(batches, column):
    for batch in batches:
        yield batch["item"].to_pylist(), batch[column].fill_null(0).to_pylist()


def _merge_leftovers(left: DataFrame, capacity: int, windows: int) -> DataFrame:
    """(container, merged): the leftovers that moved into another container."""
    moved, level = None, 0
    while True:
        task = F.shiftright("container", 36).bitwiseAND(F.lit(TASKS - 1))
        tasks, last = left.agg(F.count_distinct(task), F.max(task)).first()
        if tasks <= 1:
            return moved
        level += 1
        # each group has the leftovers of FAN_IN tasks at most, and a task of its own
        groups = last // FAN_IN + 1
        tokens = F.lit(list(partition_tokens(groups))).cast("array<int>")
        one = left.withColumn("_token", F.get(tokens, F.floor(task / FAN_IN).cast("int"))).repartition(groups, "_token")
        ordered = one.sortWithinPartitions(F.desc("left_over"), "container").select(F.col("container").alias("item"), "left_over")
        base = F.lit(level << 58)
        packed = cut(ordered.mapInArrow(_packing("left_over", _given_sizes, capacity, windows), _ROWS))
        packed = packed.withColumn("container", F.col("container") + base)
        step = packed.filter("left_over is null").select(F.col("item").alias("container"), F.col("container").alias("merged"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("container").alias("merged"), F.col("merged").alias("last"))
            moved = moved.join(later, "merged", "left").select("container", F.coalesce("last", "merged").alias("merged"))
        if groups == 1:
            return moved
        left = packed.filter("left_over is not null").select("container", "left_over")


def _finish(packed: DataFrame, capacity: int, windows: int) -> DataFrame:
    packed = cut(packed)
    placed = packed.filter("left_over is null").drop("left_over")
    moved = _merge_leftovers(packed.filter("left_over is not null").select("container", "left_over"), capacity, windows)
    if moved is not None:
        placed = placed.join(moved, "container", "left").withColumn("container", F.coalesce("merged", "container"))
    return placed.select(F.col("item").alias("doc_id"), "piece", "n_pieces", "first_token", "n_tokens", F.col("container").alias("container_id"))


def pack_documents(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """Lay every row with at least one token into containers of ``capacity`` tokens.

    Returns doc_id, piece (from 0), n_pieces, first_token, n_tokens, container_id.  A text of up to
    ``capacity`` tokens is one piece.  Null and empty texts have no token and no row; repeated rows
    and null doc_ids are packed row by row; extra columns are not read.
    """
    rows = documents.select(F.col("doc_id").alias("item"), "text")
    return _finish(rows.mapInArrow(_packing("text", _token_sizes(path), capacity, windows), _ROWS), capacity, windows)


def pack_sizes(items: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """As ``pack_documents``, for rows (doc_id, n_tokens) whose sizes are known; sizes that are
    null, zero or negative are laid nowhere."""
    rows = items.select(F.col("doc_id").alias("item"), F.col("n_tokens").cast("long").alias("n_tokens"))
    return _finish(rows.mapInArrow(_packing("n_tokens", _given_sizes, capacity, windows), _ROWS), capacity, windows)


def split_documents(packed: DataFrame) -> DataFrame:
    """doc_ids whose text alone exceeds a container."""
    return packed.filter("n_pieces > 1").select("doc_id").distinct()


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, and the share of capacity that is used."""
    return packed.agg(
        F.count("*").alias("n_pieces"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count_distinct("container_id").alias("n_containers"),
    ).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 4))
