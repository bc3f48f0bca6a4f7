"""Semantic search: nearest stored vectors to one query vector, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.tables import GraphTables


def semantic_search(t: GraphTables, vectors: DataFrame, query: list[float], k: int = 20, kind: str | None = None, prefilter: bool = True) -> DataFrame:
    """(scope, symbol_id, fqn, score) of the k most similar symbols; vectors: scope (unless ids are unique
    over all scopes), symbol_id, embedding.

    Both sides are scaled to unit length; score is the inner product, 1 - d*d/2 of the distance d.
    A kind filters before the search, or (prefilter=False) after it, when fewer than k may be left.
    Vectors of another length, with nulls or NaN, or all zero are no candidates.
    """
    norm = sum(v * v for v in query) ** 0.5
    if not norm:
        return t.symbols.select("scope", F.col("id").alias("symbol_id"), "fqn", F.lit(0.0).alias("score")).limit(0)
    unit = F.array(*[F.lit(v / norm) for v in query])
    e = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("embedding") == len(query)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    key = [c for c in ("scope", "symbol_id") if c in vectors.columns]
    rows = vectors.filter(sound).select(*key, e.alias("e"))
    add = lambda a, x: a + x
    length = F.sqrt(F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), add))
    score = F.aggregate(F.zip_with("e", unit, lambda x, y: x * y), F.lit(0.0), add) / length
    rows = rows.withColumn("score", F.round(score, 6)).filter(length > 0)
    names = t.symbols.select("scope", F.col("id").alias("symbol_id"), "fqn", "kind_name")
    if kind is None or not prefilter:
        top = rows.select(*key, "score").orderBy(F.desc("score"), *reversed(key)).limit(k).join(names, key)
        top = top if kind is None else top.filter(F.col("kind_name") == kind)
    else:
        top = rows.select(*key, "score").join(names.filter(F.col("kind_name") == kind), key)
    return top.select("scope", "symbol_id", "fqn", "score").orderBy(F.desc("score"), "symbol_id", "scope").limit(k)
