"""Most similar vectors by randomly rotated one-bit codes.

A unit vector o is rotated by a fixed random orthogonal matrix R and kept as the signs of R o
(packed bits) and one scalar f = <signs / sqrt(D), R o>.  For a unit query q the inner product with
the signs, divided by f, estimates <o, q>; its error is bounded by
EPSILON * sqrt((1 - f*f) / (f*f)) / sqrt(D - 1), exceeded with small probability only.  A vector is
compared exactly only if its upper bound reaches the requested similarity and the k-th best so far.

Two searches use the codes.  ``similar_pairs`` finds all near neighbours of all vectors: a tree of
centroids of two levels cuts space into cells of CELL vectors on average, so their number grows with
the vectors and the work for one vector doesn't.  A vector is a query in its home cell (as its rotated
form in one byte a dimension), and its code is sent to its nearest ``PROBES`` cells; vectors themselves
move only for the pairs that are compared exactly.  A pair of neighbours has two chances, one from
each side.  ``nearest`` answers a stated query set against all rows, block by block, without moving
the rows.  Vectors that are exactly equal are searched once, as a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.balance import skew_join
from codeloom.session import collect_bounded, cut

K = 10
EPSILON = 1.9
#: Vectors of a cell on average; bytes of a model's centroids at most (cells grow beyond CELL only
#: where a model has more than CELL vectors for each centroid that fits: 134 million of 64 dimensions).
CELL = 512
CENTROID_BYTES = 64 << 20
#: Vectors per model that the first level is fitted on; vectors per centroid of the second level, and
#: for one centroid of the first at most.
SAMPLE = 16_384
CHILD_VECTORS = 48
CHILD_SAMPLE = 32_768
#: Cells a code goes to, and first-level centroids whose cells it can reach.
PROBES = 8
REACH = 8
#: Queries of one block of a cell or of the stated set; base rows of one tile.
CELL_QUERIES = 2_048
BLOCK_QUERIES = 16_384
TILE = 4_096
#: Models at most (rows of embedding_models that are taken to the driver).
MODELS = 1_000
_INDEX = "model_version string, class_id long, digest binary, vector binary, cells array<int>, turned binary, step float, code binary, f float"


def sound(embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """(model_version, symbol_id, embedding, embedded_at): rows with a usable vector: as long as the
    model's dimension, no null, NaN or infinite value, not all zero.  Null symbols and unknown models
    are left out."""
    size = models.filter("version is not null and dimension > 0").groupBy(F.col("version").alias("model_version")).agg(F.max("dimension").alias("dimension"))
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.filter(F.col("symbol_id").isNotNull() & fine).select("model_version", "symbol_id", "embedding", "embedded_at")
    return rows.join(size, "model_version").filter(F.size("embedding") == F.col("dimension")).drop("dimension")


def usable(rows: DataFrame) -> DataFrame:
    """(model_version, symbol_id, embedding): of a symbol's and model's sound rows the one with the
    latest embedded_at (equal times: the greatest vector)."""
    order = F.struct(F.col("embedded_at").isNotNull(), "embedded_at", "embedding")
    return rows.groupBy("model_version", "symbol_id").agg(F.max_by("embedding", order).alias("embedding"))


def vector_classes(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, leaders).  classes: the index with one row per distinct vector, class_id
    being its least symbol.  members (class_id, symbol_id, size) and leaders (class_id, ids: the K + 1
    least symbols) only for classes with several symbols.  Vectors are told apart by 128-bit digests."""
    keys = ["model_version", "digest"]
    symbols = index.select(*keys, F.col("class_id").alias("symbol_id"))
    several = cut(symbols.groupBy(*keys).agg(F.min("symbol_id").alias("class_id"), F.count("*").alias("size")).filter("size > 1"))
    members = cut(skew_join(symbols, several, keys, ["symbol_id"], "inner").select("model_version", "class_id", "symbol_id", "size"))
    place = F.row_number().over(W.partitionBy("model_version", "class_id").orderBy("symbol_id"))
    first = members.withColumn("_place", place).filter(F.col("_place") <= K + 1)
    leaders = first.groupBy("model_version", "class_id").agg(F.sort_array(F.collect_list("symbol_id")).alias("ids"), F.first("size").alias("size"))
    others = members.filter("symbol_id != class_id").select("model_version", F.col("symbol_id").alias("class_id"))
    classes = index if several.isEmpty() else index.join(others, ["model_version", "class_id"], "left_anti")
    return classes, members, leaders


def rotation(dimension: int) -> np.ndarray:
    """The random orthogonal matrix for a dimension; codes have a multiple of eight bits, shorter
    vectors are padded with zeros."""
    wide = -(-dimension // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(dimension).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :dimension].T.astype(np.float32)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, f) of unit vectors."""
    turned = units @ turn
    bits = turned > 0
    f = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return np.packbits(bits, axis=1), np.maximum(f, 1e-3).astype(np.float32)


def bounds(f: np.ndarray, wide: int, epsilon: float = EPSILON) -> np.ndarray:
    """Error bound of the estimates from codes with scalars f."""
    return (epsilon * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(1, wide - 1))).astype(np.float32)


def estimates(turned: np.ndarray, codes: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Estimated inner products of rotated queries (rows) with coded vectors (columns)."""
    wide = turned.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return (turned @ signs.T) / (f * np.float32(np.sqrt(wide)))


def fit_centroids(units: np.ndarray, count: int, turns: int = 4) -> np.ndarray:
    """Spherical k-means of a sample, from its first rows."""
    centroids = units[:count].copy()
    for _ in range(turns):
        nearest = np.concatenate([np.argmax(units[k : k + TILE] @ centroids.T, axis=1) for k in range(0, len(units), TILE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centroids)
    return centroids


def _units(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


class Cells:
    """Two levels of centroids of one model: ``first``, and ``second`` with the children of the k-th
    first-level centroid at starts[k]:starts[k+1]."""

    def __init__(self, first: np.ndarray, children: list[np.ndarray]):
        self.first, self.second = first, np.concatenate(children)
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in children])])

    def nearest(self, units: np.ndarray, probes: int = PROBES, reach: int = REACH) -> np.ndarray:
        """The nearest cells of each vector, nearest first; -1 where there are fewer."""
        reach = min(reach, len(self.first))
        close = units @ self.first.T
        top = np.argpartition(-close, reach - 1, axis=1)[:, :reach]
        score = np.full((len(units), reach * probes), -9, np.float32)
        name = np.full((len(units), reach * probes), -1, np.int32)
        owner = top.reshape(-1)
        order = np.argsort(owner, kind="stable")
        spots = np.searchsorted(owner[order], np.arange(len(self.first) + 1))
        for k in np.unique(owner):
            hit = order[spots[k] : spots[k + 1]]
            rows, slot = hit // reach, hit % reach
            near = units[rows] @ self.second[self.starts[k] : self.starts[k + 1]].T
            few = min(probes, near.shape[1])
            best = np.argpartition(-near, few - 1, axis=1)[:, :few]
            columns = slot[:, None] * probes + np.arange(few)
            score[rows[:, None], columns] = np.take_along_axis(near, best, 1)
            name[rows[:, None], columns] = best + self.starts[k]
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(name, best, 1)


def fit_cells(rows: DataFrame) -> dict[str, Cells]:
    """Centroids of every model.  The first level has the square root of the wished number of cells
    and is fitted on SAMPLE vectors (fewer where there are many models); for the second, CHILD_VECTORS vectors per cell are placed on the
    first and each first-level centroid's own are clustered in a task, into as many children as they
    are times CHILD_VECTORS (of more than CHILD_SAMPLE only so many are looked at)."""
    spark = rows.sparkSession
    counts = {r["model_version"]: (r["n"], r["d"]) for r in collect_bounded(rows.groupBy("model_version").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")), MODELS)}
    few = min(SAMPLE, max(1_024, 4 * SAMPLE // max(1, len(counts))))
    wished = {model: max(1, min(-(-n // CELL), CENTROID_BYTES // (4 * d))) for model, (n, d) in counts.items()}
    shares = [(model, max(1, n // few), max(1, n // (wished[model] * CHILD_VECTORS))) for model, (n, _) in sorted(counts.items())]
    table = F.broadcast(spark.createDataFrame(shares, "model_version string, _first long, _share long"))  # a row per model
    rows = rows.join(table, "model_version")
    sample = rows.filter(F.pmod(F.xxhash64("symbol_id"), F.col("_first")) == 0).select("model_version", "symbol_id", "embedding").limit(4 * few * max(1, len(counts))).toArrow()
    sample = sample.sort_by([("model_version", "ascending"), ("symbol_id", "ascending")]).combine_chunks()
    names, first = np.array(sample["model_version"].to_pylist(), object), {}
    for model, (_, dimension) in sorted(counts.items()):
        own = sample.filter(pa.array(names == model)).combine_chunks()
        units = _units(own["embedding"].chunk(0)) if own.num_rows else np.eye(1, dimension, dtype=np.float32)
        order = np.random.default_rng(7).permutation(len(units))
        first[model] = fit_centroids(units[order], min(len(units), math.ceil(wished[model] ** 0.5)))
    if not first:
        return {}
    thinned = rows.filter(F.pmod(F.xxhash64("symbol_id", F.lit(5)), F.col("_share")) == 0)
    top = spark.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch["model_version"].to_pylist(), object)
            for model in dict.fromkeys(names):
                own = batch.filter(pa.array(names == model))
                units = _units(own["embedding"])
                at = np.argmax(units @ top.value[model].T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"model_version": own["model_version"], "symbol_id": own["symbol_id"], "at": pa.array(at), "unit": pa.array([u.tobytes() for u in units], pa.binary())})

    placed = thinned.select("model_version", "symbol_id", "embedding").mapInArrow(place, "model_version string, symbol_id long, at int, unit binary")
    per = placed.groupBy("model_version", "at").agg(F.count("*").alias("n"))
    sizes = F.broadcast(per)  # a row per first-level centroid
    placed = placed.join(sizes, ["model_version", "at"]).filter(F.pmod(F.xxhash64("symbol_id", F.lit(9)), F.ceil(F.col("n") / CHILD_SAMPLE)) == 0)

    def children(group: pa.Table) -> pa.Table:
        group = group.sort_by([("symbol_id", "ascending"), ("unit", "ascending")])
        units = _matrix(group["unit"], np.float32)
        units = units[np.random.default_rng(11).permutation(len(units))]
        n = min(-(-group["n"][0].as_py() // CHILD_VECTORS), max(1, len(units) // 2))
        found = fit_centroids(units, n)
        return pa.Table.from_pydict({"model_version": [group["model_version"][0].as_py()] * n, "at": pa.array([group["at"][0].as_py()] * n, pa.int32()), "nth": pa.array(np.arange(n), pa.int32()), "unit": pa.array([u.tobytes() for u in found], pa.binary())})

    found = placed.groupBy("model_version", "at").applyInArrow(children, "model_version string, at int, nth int, unit binary")
    most = sum(2 * CENTROID_BYTES // (4 * d) for _, d in counts.values())
    by: dict[tuple[str, int], list] = {}
    for r in sorted(collect_bounded(found, most), key=lambda r: (r["model_version"], r["at"], r["nth"])):
        by.setdefault((r["model_version"], r["at"]), []).append(np.frombuffer(r["unit"], np.float32))
    return {m: Cells(c, [np.array(by.get((m, k), [c[k]])) for k in range(len(c))]) for m, c in first.items()}


def build_index(rows: DataFrame) -> DataFrame:
    """Every usable vector of the sound rows with its digest, cells (home first), rotated form in one
    byte a dimension with its step, code and scalar; class_id is the symbol for now."""
    cells = rows.sparkSession.sparkContext.broadcast(fit_cells(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch["model_version"].to_pylist(), object)
            for model in dict.fromkeys(models):
                own = batch.filter(pa.array(models == model))
                raw = own["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(own.num_rows, -1) + np.float32(0)
                units = unit_rows(raw)
                best = cells.value[model].nearest(units)
                turn = rotation(units.shape[1])
                codes, f = encode(units, turn)
                turned, step = squeeze(units @ turn)
                each = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
                vectors = [x.tobytes() for x in raw]
                kept = best >= 0
                yield pa.RecordBatch.from_pydict({
                    "model_version": own["model_version"], "class_id": own["symbol_id"], "digest": pa.array([xxhash.xxh3_128_digest(v) for v in vectors], pa.binary()), "vector": pa.array(vectors, pa.binary()),
                    "cells": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept.sum(1))]).astype(np.int32), best[kept]), "turned": each(turned), "step": pa.array(step), "code": each(codes), "f": pa.array(f),
                })

    return cut(usable(rows).mapInArrow(run, _INDEX))


def squeeze(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated queries in signed bytes, and the step of each."""
    step = np.maximum(np.abs(turned).max(1) / 127, 1e-9).astype(np.float32)
    return np.rint(turned / step[:, None]).astype(np.int8), step


def _matrix(column, kind) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _candidates(least: float):
    """Per block of a cell: base rows whose upper bound reaches ``least`` and the K-th best lower
    bound of the query."""

    def run(key, queries: pa.Table, bases: pa.Table) -> pa.Table:
        schema = pa.schema([("model_version", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        out_a, out_b = [], []
        if queries.num_rows and bases.num_rows:
            step = queries["step"].to_numpy()
            turned = _matrix(queries["turned"], np.int8).astype(np.float32) * step[:, None]
            ids, base_ids = queries["class_id"].to_numpy(), bases["base_id"].to_numpy()
            codes, f = _matrix(bases["code"], np.uint8), bases["f"].to_numpy()
            # the bytes' rounding errors are independent of the signs; three of their deviations are added
            error = bounds(f, turned.shape[1]) + np.float32(3 / 12**0.5) * step.max() / f
            for start in range(0, len(ids), 256):
                part = slice(start, start + 256)
                estimate = estimates(turned[part], codes, f)
                estimate[ids[part][:, None] == base_ids[None, :]] = -2
                floor = np.full(len(estimate), least, np.float32)
                if estimate.shape[1] > K:
                    lower = estimate - error
                    floor = np.maximum(floor, np.minimum(1, -np.partition(-lower, K - 1, axis=1)[:, K - 1]))
                q, b = np.nonzero((estimate + error >= floor[:, None]) & (estimate > -2))
                out_a.append(ids[part][q])
                out_b.append(base_ids[b])
        a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a), pa.array(b)], schema=schema)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of pairs (model_version, a, b, v_a, v_b)."""
    for batch in batches:
        models = np.array(batch["model_version"].to_pylist(), object)
        for model in dict.fromkeys(models):  # the vectors of a model are equally long
            own = batch.filter(pa.array(models == model))
            x, y = (_matrix(own[c], np.float32).astype(np.float64) for c in ("v_a", "v_b"))
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_pydict({"model_version": own["model_version"], "a": own["a"], "b": own["b"], "similarity": pa.array(cosine)})


def class_pairs(classes: DataFrame, least: float) -> DataFrame:
    """(model_version, a, b, similarity): for each class a up to K other classes b of at least
    ``least``, by exact similarity, then class id."""
    slim = classes.select("model_version", "class_id", "cells", "turned", "step", "code", "f")
    counted = slim.groupBy("model_version", F.get("cells", F.lit(0)).alias("cell")).agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("blocks"))
    blocks = collect_bounded(counted.filter("blocks > 1"), 1 << 24)  # crowded cells only, one row per centroid at most
    schema = T.StructType([T.StructField("model_version", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("blocks", T.IntegerType())])
    blocks = F.broadcast(classes.sparkSession.createDataFrame([tuple(r) for r in blocks], schema))
    n = F.coalesce("blocks", F.lit(1))
    queries = slim.select("model_version", F.get("cells", F.lit(0)).alias("cell"), "class_id", "turned", "step").join(blocks, ["model_version", "cell"], "left")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("class_id"), n).cast("int")).drop("blocks")
    bases = slim.select("model_version", F.explode("cells").alias("cell"), "class_id", "code", "f").join(blocks, ["model_version", "cell"], "left")
    bases = bases.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
    bases = bases.toDF("model_of_base", "cell_of_base", "base_id", "code", "f", "block_of_base")  # names of its own
    sides = queries.groupBy("model_version", "cell", "block").cogroup(bases.groupBy("model_of_base", "cell_of_base", "block_of_base"))
    found = sides.applyInArrow(_candidates(least), "model_version string, a long, b long")
    found = found.select("model_version", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: classes.select("model_version", F.col("class_id").alias(x), F.col("vector").alias(f"v_{x}"))
    both = found.join(side("a"), ["model_version", "a"]).join(side("b"), ["model_version", "b"])
    exact = both.select("model_version", "a", "b", "v_a", "v_b").mapInArrow(_exact, "model_version string, a long, b long, similarity double").filter(F.col("similarity") >= least)
    exact = cut(exact)
    ways = exact.unionByName(exact.select("model_version", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = W.partitionBy("model_version", "a").orderBy(F.desc("similarity"), "b")
    return ways.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= K)


def expand(pairs: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(model_version, symbol_id, other_id, similarity): neighbours of symbols from those of classes.

    Symbols of one class are each other's first neighbours, least ids first; then follow the symbols
    of other classes, best class first, least ids first, K in all.
    """
    lead = leaders.select("model_version", F.col("class_id").alias("b"), "ids")
    sizes = leaders.select("model_version", F.col("class_id").alias("a"), F.col("size").alias("own"))
    wide = pairs.join(lead, ["model_version", "b"], "left").join(sizes, ["model_version", "a"], "left")
    rows = wide.select("model_version", "a", "similarity", "place", F.coalesce("own", F.lit(1)).alias("own"), F.posexplode(F.coalesce("ids", F.array("b"))).alias("turn", "other_id"))
    order = W.partitionBy("model_version", "a").orderBy("place", "turn")
    rows = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= K - (F.col("own") - 1))
    people = members.select("model_version", F.col("class_id").alias("a"), "symbol_id")
    other = rows.join(people, ["model_version", "a"], "left").select("model_version", F.coalesce("symbol_id", "a").alias("symbol_id"), "other_id", "similarity")
    inside = skew_join(members, leaders.select("model_version", "class_id", "ids"), ["model_version", "class_id"], ["symbol_id"], "inner")
    kept = F.slice(F.filter("ids", lambda x: x != F.col("symbol_id")), 1, K)
    inside = inside.select("model_version", "symbol_id", F.explode(kept).alias("other_id"), F.lit(1.0).alias("similarity"))
    return other.unionByName(inside)


def similar_pairs(embeddings: DataFrame, models: DataFrame, least: float = 0.9) -> DataFrame:
    """(symbol_id_a, symbol_id_b), a < b, of one model, whose cosine is at least ``least`` and of
    which one is among the K most similar of the other."""
    classes, members, leaders = vector_classes(build_index(sound(embeddings, models)))
    rows = expand(class_pairs(classes, least), members, leaders)
    return rows.select(F.least("symbol_id", "other_id").alias("symbol_id_a"), F.greatest("symbol_id", "other_id").alias("symbol_id_b")).distinct()


def _nearest_tiles(query_ids, units, model: str):
    """For a broadcast block of queries: K best of each partition, exact, chosen by code bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = query_ids.value, units.value
        turned = vectors @ rotation(vectors.shape[1])
        best = np.full((len(ids), K), -2, np.float32)
        names = np.full((len(ids), K), -1, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                batch = whole.slice(start, TILE)
                base, base_ids = unit_rows(_matrix(batch["vector"], np.float32)), batch["class_id"].to_numpy()
                codes, f = _matrix(batch["code"], np.uint8), batch["f"].to_numpy()
                error = bounds(f, turned.shape[1])
                for at in range(0, len(ids), 1024):
                    part = slice(at, at + 1024)
                    upper = estimates(turned[part], codes, f) + error
                    mine = ids[part]
                    floor = best[part].min(1)
                    q, b = np.nonzero(upper >= floor[:, None])
                    keep = mine[q] != base_ids[b]
                    q, b = q[keep], b[keep]
                    if not len(q):
                        continue
                    dense = len(q) > 0.1 * upper.size
                    exact = (vectors[part] @ base.T)[q, b] if dense else np.einsum("ij,ij->i", vectors[part][q], base[b])
                    n = len(mine)
                    rows = np.concatenate([np.repeat(np.arange(n), K), q])
                    value = np.concatenate([best[part].reshape(-1), exact])
                    other = np.concatenate([names[part].reshape(-1), base_ids[b]])
                    order = np.lexsort((other, -value, rows))
                    first = np.searchsorted(rows[order], np.arange(n))
                    take = order[first[:, None] + np.arange(K)]
                    best[part], names[part] = value[take], other[take]
        q, k = np.nonzero(names >= 0)
        yield pa.RecordBatch.from_pydict({"model_version": pa.array([model] * len(q), pa.string()), "a": pa.array(ids[q]), "b": pa.array(names[q, k]), "similarity": pa.array(best[q, k].astype(np.float64))})

    return run


def nearest(embeddings: DataFrame, models: DataFrame, chosen) -> DataFrame:
    """(model_version, symbol_id, other_id, similarity): the K most similar vectors of every usable
    symbol for which the predicate ``chosen`` (a function of a column) holds, against all vectors of
    the model.  Queries go round in blocks of BLOCK_QUERIES vectors, so each broadcast is bounded."""
    index, members, leaders = vector_classes(build_index(sound(embeddings, models)))
    spark = embeddings.sparkSession
    several = members.filter(chosen(F.col("symbol_id"))).select("model_version", "class_id")
    single = index.select("model_version", "class_id").filter(chosen(F.col("class_id")))
    asked = several.union(single).distinct()
    queries = cut(index.join(asked, ["model_version", "class_id"], "left_semi").select("model_version", "class_id", "vector"))
    found = None
    for row in sorted(collect_bounded(queries.groupBy("model_version").count(), MODELS)):
        model, blocks = row["model_version"], -(-row["count"] // (BLOCK_QUERIES * 3 // 4))
        for k in range(blocks):
            mine = (F.col("model_version") == model) & (F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == k)
            block = queries.filter(mine).select("class_id", "vector").toArrow()
            if not block.num_rows:
                continue
            ids, units = spark.sparkContext.broadcast(block["class_id"].to_numpy()), spark.sparkContext.broadcast(unit_rows(_matrix(block["vector"], np.float32)))
            base = index.filter(F.col("model_version") == model).select("class_id", "vector", "code", "f")
            best = base.mapInArrow(_nearest_tiles(ids, units, model), "model_version string, a long, b long, similarity double")
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "model_version string, a long, b long, similarity double")
    order = W.partitionBy("model_version", "a").orderBy(F.desc("similarity"), "b")
    pairs = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= K)
    rows = expand(pairs, members, leaders).filter(chosen(F.col("symbol_id")))
    return rows.select("model_version", "symbol_id", "other_id", F.round("similarity", 5).alias("similarity"))
