"""Placement of keyed rows on tasks by estimated load.

Keys are hashed to a fixed number of buckets, the buckets' loads are counted with map-side
combining, and only inside overloaded buckets are single keys counted.  The driver therefore
sees a bounded summary (``BUCKETS`` loads and a few heavy keys), whatever the number of keys.
Buckets are bin-packed on tasks, longest first; a heavy key is cut into shards in proportion to
its load, each shard packed like a bucket.  Rows of the matching side go to the task of their
bucket or, for heavy keys, to each task that holds a shard, and to no other task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import collect_bounded, shuffle_partitions

BUCKETS = 1024
#: A key with fewer rows than this is never split: a task takes them in its stride.
LEAST_HEAVY = 10_000


def _murmur3_int(value: int, seed: int = 42) -> int:
    """Spark's hash() of one int column (public Murmur3 x86 32), as a signed int."""
    mask = 0xFFFFFFFF
    k = (value & mask) * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) & mask
    h = seed ^ (k * 0x1B873593 & mask)
    h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=64)
def partition_tokens(tasks: int) -> tuple[int, ...]:
    """For each task t an int that ``repartition(tasks, token)`` sends to partition t."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < tasks:
        found.setdefault(_murmur3_int(value) % tasks, value)
        value += 1
    return tuple(found[t] for t in range(tasks))


@dataclass(frozen=True)
class Placement:
    """Where each key goes: ``buckets[b]`` is the token of bucket b; ``heavy`` maps a key's hash
    to the tokens of its shards."""

    tasks: int
    keys: tuple[str, ...]
    buckets: tuple[int, ...]
    heavy: tuple[tuple[int, tuple[int, ...]], ...]
    loads: tuple[int, ...]


def key_hash(keys) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def bucket_of(keys) -> Column:
    return F.pmod(key_hash(keys), F.lit(BUCKETS)).cast("int")


def plan_placement(df: DataFrame, keys, tasks: int | None = None, grain: int = 2) -> Placement:
    """Count loads and pack.  A key is heavy above 1/(grain * tasks) of all rows (and LEAST_HEAVY
    rows), so there are at most grain * tasks heavy keys; null keys are rows like any others.  The
    second count runs only where a bucket is crowded, over the rows of such buckets."""
    keys = tuple(keys)
    tasks = tasks or shuffle_partitions(df.sparkSession)
    hashed = df.select(key_hash(keys).alias("h")).withColumn("b", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sizes = {r["b"]: r["n"] for r in collect_bounded(hashed.groupBy("b").agg(F.count("*").alias("n")), BUCKETS)}
    target = max(1, sum(sizes.values()) // (grain * tasks))
    crowded = [b for b, n in sizes.items() if n > max(target, LEAST_HEAVY)]
    heavy: dict[int, int] = {}
    if crowded:
        counts = hashed.filter(F.col("b").isin(crowded)).groupBy("h").agg(F.count("*").alias("n"), F.first("b").alias("b"))
        for r in collect_bounded(counts.filter(F.col("n") > max(target, LEAST_HEAVY)), grain * tasks + 1):
            heavy[r["h"]] = r["n"]
            sizes[r["b"]] -= r["n"]
    items = [(n, 0, b, 0) for b, n in sizes.items()]
    for h, n in heavy.items():
        shards = min(tasks, -(-n // target))
        items += [(n // shards, 1, h, s) for s in range(shards)]
    tokens = partition_tokens(tasks)
    bins = [(0, t) for t in range(tasks)]
    bucket_task = {b: b % tasks for b in range(BUCKETS)}
    shard_tasks: dict[int, list[int]] = {h: [] for h in heavy}
    for n, is_shard, what, _ in sorted(items, key=lambda x: (-x[0], x[1], x[2], x[3])):
        load, t = heapq.heappop(bins)
        if is_shard:
            shard_tasks[what].append(t)
        else:
            bucket_task[what] = t
        heapq.heappush(bins, (load + n, t))
    return Placement(
        tasks,
        keys,
        tuple(tokens[bucket_task[b]] for b in range(BUCKETS)),
        tuple((h, tuple(tokens[t] for t in sorted(set(ts)))) for h, ts in sorted(shard_tasks.items())),
        tuple(n for n, _ in sorted(bins)),
    )


def _with_shards(df: DataFrame, placement: Placement) -> DataFrame:
    """Add _tokens: the shard tokens of a heavy key, null for others.  The joined table has at
    most grain * tasks rows by construction, so broadcasting it is bounded."""
    if not placement.heavy:
        return df.withColumn("_tokens", F.lit(None).cast("array<int>"))
    schema = T.StructType([T.StructField("_h", T.LongType()), T.StructField("_tokens", T.ArrayType(T.IntegerType()))])
    table = df.sparkSession.createDataFrame([(h, list(ts)) for h, ts in placement.heavy], schema)
    return df.withColumn("_h", key_hash(placement.keys)).join(F.broadcast(table), "_h", "left").drop("_h")


def _bucket_token(placement: Placement) -> Column:
    table = F.lit(list(placement.buckets)).cast("array<int>")
    return F.get(table, bucket_of(placement.keys))


def place_fragments(df: DataFrame, placement: Placement, spread) -> DataFrame:
    """Add ``_token`` to rows of the split side.  ``spread`` are columns whose hash picks the
    shard: rows equal in them stay together, and a recomputed task places them alike."""
    marked = _with_shards(df, placement)
    pick = F.get("_tokens", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.size("_tokens").cast("long")).cast("int"))
    return marked.withColumn("_token", F.when(F.col("_tokens").isNull(), _bucket_token(placement)).otherwise(pick)).drop("_tokens")


def place_replicas(df: DataFrame, placement: Placement) -> DataFrame:
    """Add ``_token`` to rows of the matching side, one copy for each task that needs the row."""
    marked = _with_shards(df, placement)
    where = F.when(F.col("_tokens").isNull(), F.array(_bucket_token(placement))).otherwise(F.col("_tokens"))
    return marked.withColumn("_token", F.explode(where)).drop("_tokens")


def co_partition(df: DataFrame, placement: Placement) -> DataFrame:
    """One shuffle that puts each token's rows into a task of its own."""
    return df.repartition(placement.tasks, "_token")


def skew_join(left: DataFrame, right: DataFrame, keys, spread, how: str = "left") -> DataFrame:
    """Join a side with hot keys to a side whose keys are unique: hot keys are cut into shards by
    the columns ``spread``, and only their rows of the right side are replicated."""
    keys = list(keys)
    placement = plan_placement(left, keys)
    if not placement.heavy:
        return left.join(right, keys, how)
    one, other = place_fragments(left, placement, spread), place_replicas(right, placement)
    return one.join(other, ["_token", *keys], how).drop("_token")
