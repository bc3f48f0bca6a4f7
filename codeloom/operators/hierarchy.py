"""Parent-child links to full hierarchies by fragment contraction.

Each level splits the nodes into partitions.  Inside a partition, chains of parents are followed
as far as they stay inside: every node learns its exit, the first ancestor outside (or none, if
its chain ends or circles inside) and the segment from the exit down to it.  The distinct exits of
all partitions are the nodes of the quotient forest, each with the segment it got in its own
partition.  The quotient is far smaller (leaves never enter it) and is solved the same way; once
it fits one task, it is solved there.  On the way back the solved exits are joined to the nodes of
each partition and their paths put in front of the local segments.

A star is no problem: all children of one outside parent share one exit per partition.  Where a
level hardly shrinks (long chains whose links all leave their partition), the next level places
nodes by a coin: tails move to the partition of their parent, so that a constant share of links
becomes local whatever the ids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import collect_bounded, cut, shuffle_partitions

#: Rows of a quotient that one task solves at most on its own; the nodes themselves are always split, into
#: fragments of FRAGMENT_ROWS as far as there are tasks.
TASK_ROWS = 200_000
FRAGMENT_ROWS = 2_000
#: Exits (ids alone) that are broadcast at most; more are joined by a shuffle.
FEW_EXITS = 500_000
_LEVEL = "pid int, id long, exit long, circle long, seg_ids array<long>, seg_names array<string>, seg_min long, size long"
_NAMELESS = _LEVEL.replace(", seg_ids array<long>, seg_names array<string>", "")


def _local_order(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For local parent positions (-1: outside or none): positions with parents before children,
    and for each position the smallest index ... of its circle, marked by a label or -1."""
    n = len(parent)
    degree = np.bincount(parent[parent >= 0], minlength=n)
    stack, peeled = list(np.flatnonzero(degree == 0)), []
    while stack:  # children before parents; what stays lies on circles
        v = stack.pop()
        peeled.append(v)
        p = parent[v]
        if p >= 0:
            degree[p] -= 1
            if degree[p] == 0:
                stack.append(p)
    label = np.full(n, -1, np.int64)
    left = np.ones(n, bool)
    left[peeled] = False
    for v in np.flatnonzero(left):
        while label[v] < 0:
            start, at = v, v
            while label[at] < 0:
                label[at] = start
                at = parent[at]
    return np.array(peeled[::-1], np.int64), label


def _contract(ids, parents, seg_ids, seg_names, seg_min, size, known, pid: int, full: bool) -> pa.RecordBatch:
    """Follow parents inside one partition.  A node without a parent is its own exit's end: exit
    is null.  ``circle`` is the least id on the circle that a node's chain runs into, if it is found
    here or ``known`` from a level below."""
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents)
    at = np.where(at < len(ids), at, 0)
    local = order[at] if len(ids) else at
    has = parents != _NONE
    inside = has & (ids[local] == parents) if len(ids) else has
    parent = np.where(inside, local, -1)
    down, label = _local_order(parent)
    exits = np.where(has & ~inside, parents, _NONE)
    circle = known.copy()
    least, total = seg_min.copy(), size.copy()
    chains_ids = list(seg_ids) if full else None
    chains_names = list(seg_names) if full else None
    on = np.flatnonzero(label >= 0)
    if len(on):
        lows = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lows, label[on], seg_min[on])
        circle[on] = lows[label[on]]
    for v in down:
        p = parent[v]
        if p < 0:
            continue
        exits[v], circle[v] = exits[p], circle[p]
        if label[p] < 0:
            least[v], total[v] = min(least[p], least[v]), total[p] + total[v]
            if full:
                chains_ids[v] = np.concatenate([chains_ids[p], chains_ids[v]])
                chains_names[v] = np.concatenate([chains_names[p], chains_names[v]])
    none = lambda a: pa.array(a, pa.int64(), mask=a == _NONE)
    columns = {"pid": pa.array(np.full(len(ids), pid, np.int32)), "id": pa.array(ids), "exit": none(exits), "circle": none(circle)}
    if full:
        columns["seg_ids"] = pa.array(chains_ids, pa.list_(pa.int64()))
        columns["seg_names"] = pa.array(chains_names, pa.list_(pa.string()))
    columns |= {"seg_min": pa.array(least), "size": pa.array(total)}
    return pa.RecordBatch.from_pydict(columns)


#: Stands for null inside numpy arrays; no id may have this value.
_NONE = np.iinfo(np.int64).min


def _contractor(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            return
        longs = lambda c: table[c].fill_null(_NONE).to_numpy()
        ids, names = None, None
        if full and "name" in table.column_names:  # the nodes themselves: each is its own segment
            ids = list(table["id"].to_numpy()[:, None])
            names = [np.array([x], object) for x in table["name"].to_pylist()]
        elif full:
            ids = [np.array(x, np.int64) for x in table["seg_ids"].to_pylist()]
            names = [np.array(x, object) for x in table["seg_names"].to_pylist()]
        done = _contract(longs("id"), longs("parent"), ids, names, longs("seg_min"), longs("size"), longs("circle"), TaskContext.get().partitionId(), full)
        for start in range(0, done.num_rows, 20_000):
            yield done.slice(start, 20_000)

    return run


def _level(nodes: DataFrame, parts: int, full: bool, by_coin: int | None) -> DataFrame:
    """One contraction of (id, parent, seg_ids, seg_names, seg_min, size, circle)."""
    if parts == 1:
        placed = nodes.coalesce(1)
    elif by_coin is None:
        placed = nodes.repartitionByRange(parts, "id")
    else:
        crowd = nodes.filter("parent is not null").groupBy("parent").count().filter(F.col("count") > TASK_ROWS // 4)
        hot = [r[0] for r in collect_bounded(crowd.select("parent"), 8 * parts + 8)]
        tails = (F.pmod(F.xxhash64("id", F.lit(by_coin)), F.lit(2)) == 0) & F.col("parent").isNotNull()
        if hot:
            tails &= ~F.col("parent").isin(hot)
        placed = nodes.withColumn("_home", F.when(tails, F.col("parent")).otherwise(F.col("id"))).repartition(parts, "_home").drop("_home")
    return cut(placed.mapInArrow(_contractor(full), _LEVEL if full else _NAMELESS))


def _solve(nodes: DataFrame, count: int, full: bool, by_coin: int | None = None, task_rows: int = TASK_ROWS, quotient: bool = True) -> DataFrame:
    """Per node: root-to-node ids and names (if full), depth counted in nodes, and circle."""
    parts = 1 if count <= task_rows else -(-count // task_rows)
    if not quotient:
        parts = max(2, parts)
    if parts > 1 and by_coin is None:
        parts = max(parts, min(shuffle_partitions(nodes.sparkSession), -(-count // min(FRAGMENT_ROWS, task_rows))))
    level = _level(nodes, parts, full, by_coin)
    lists = ["seg_ids", "seg_names"] if full else []
    if parts == 1:
        return level.select("id", *lists, "size", "circle")
    exits = cut(level.select(F.col("exit").alias("id")).filter("id is not null").distinct())
    if exits.count() <= FEW_EXITS:  # so the nodes, of which few are exits, needn't be moved to them
        exits = F.broadcast(exits)
    # an exit without a row of its own finds no answer below, which makes its fragment a tree; one that
    # runs into a circle of its partition stays in the quotient, so that what hangs below learns it
    quotient = cut(level.select("id", *lists, "seg_min", "size", "circle", F.col("exit").alias("parent")).join(exits, "id"))
    left = quotient.count()
    slow = left > 0.75 * count
    solved = _solve(quotient, left, full, (by_coin or 0) + 1 if slow else None, task_rows)
    # each partition asks for its own exits, so that no key holds more rows than one partition; chains
    # that end inside their partition are solved already and stay where they are
    open_ = F.col("exit").isNotNull()
    done = level.filter(~open_).select("id", *lists, "size", "circle")
    wanted = level.select("pid", "exit").filter("exit is not null").distinct()
    renamed = [F.col(c).alias(f"top_{c}") for c in (*lists, "size", "circle")]
    answers = wanted.join(solved.select(F.col("id").alias("exit"), *renamed), "exit")
    joined = level.filter(open_).join(answers, ["pid", "exit"], "left")
    put = [F.coalesce(F.concat(f"top_{c}", c), F.col(c)).alias(c) for c in lists]
    return done.unionByName(joined.select("id", *put, (F.coalesce("top_size", F.lit(0)) + F.col("size")).alias("size"), F.coalesce("circle", "top_circle").alias("circle")))


def live_nodes(symbols: DataFrame) -> DataFrame:
    """(id, parent, name): one row per id with a live row (of several, the one with the latest
    added_at, then the least container).  A container without a live row ends the chain: it is an
    exit that nobody answers for."""
    live = symbols.filter(F.col("deleted_at").isNull() & F.col("id").isNotNull())
    row = F.struct(F.col("added_at").isNotNull(), "added_at", -F.coalesce("container_id", F.lit(0)), F.col("container_id").alias("container_id"), F.col("name").alias("name"))
    nodes = live.groupBy("id").agg(F.max(row).alias("r"))
    return nodes.select("id", F.col("r.container_id").alias("parent"), F.col("r.name").alias("name"))


def resolve_hierarchy(nodes: DataFrame, full: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """Solve the forest of (id, parent, name); a parent that is no id ends the chain.

    Returns id, depth (0 at a root), root_id, ancestors (ids from the root to the node itself),
    path (their names; a null name stays null) and cycle_id, the least id on the circle that the
    chain runs into.  For nodes on or below a circle the other columns are null.  With full=False
    only id, depth and cycle_id.  Empty input gives an empty result.
    """
    base = nodes.select(
        "id",
        "parent",
        *(["name"] if full else []),
        F.col("id").alias("seg_min"),
        F.lit(1).cast("long").alias("size"),
        F.lit(None).cast("long").alias("circle"),
    )
    base = cut(base)
    solved = _solve(base, base.count(), full, task_rows=task_rows, quotient=False)
    ok = F.col("circle").isNull()
    depth = F.when(ok, F.col("size") - 1).cast("int").alias("depth")
    if not full:
        return solved.select("id", depth, F.col("circle").alias("cycle_id"))
    return solved.select(
        "id",
        depth,
        F.when(ok, F.get("seg_ids", F.lit(0))).alias("root_id"),
        F.when(ok, F.col("seg_ids")).alias("ancestors"),
        F.when(ok, F.col("seg_names")).alias("path"),
        F.col("circle").alias("cycle_id"),
    )


def find_cycles(symbols: DataFrame) -> DataFrame:
    """(id, cycle_id) of every node on or below a circle of containers."""
    solved = resolve_hierarchy(live_nodes(symbols), full=False)
    return solved.filter("cycle_id is not null").select("id", "cycle_id")


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every node with each of its proper descendants,
    spread over the nodes' own rows, so that a root with many descendants is no group."""
    pairs = solved.filter("cycle_id is null").select("id", "depth", F.posexplode("ancestors").alias("at", "ancestor_id"))
    return pairs.filter("ancestor_id != id").select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))
