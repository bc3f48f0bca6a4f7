"""Functions paired with their documentation; inherited documentation is resolved iteratively."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import normal_kind
from codeloom.llm.doctext import judge
from codeloom.operators.balance import skew_join
from codeloom.session import cut

#: A signature that says something (white space of any kind is blank).
SIGNED = r"[^\s\u00a0\u3000]"
#: Open candidates that one task follows to their end, once the first rounds have thinned them out.
OPEN_ROWS = 200_000
ROUNDS_FIRST = 2
KINDS = ("method", "constructor", "operator", "function")
_JUDGED = "id long, container_id long, name string, fqn string, kind string, signature string, state string, text string, added_at timestamp_ntz"


def judge_symbols(symbols: DataFrame) -> DataFrame:
    """Live functions with what their own comment says: state 'own' (text is the documentation),
    'inherits' (text is the named target, if any) or 'none'.  Rows with a null id are left out;
    signatures may still be null or blank here, since a base without one can lend its text."""
    blank = F.trim(F.translate("kind_name", "\t\r\n", "   "))
    live = symbols.filter(F.col("deleted_at").isNull() & F.col("id").isNotNull() & F.lower(blank).isin(*KINDS))
    columns = ["id", "container_id", "name", "fqn", "canonical_key", F.lower(blank).alias("kind"), "signature", "xml_summary", F.col("added_at").cast("timestamp_ntz").alias("added_at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [batch[c].to_pylist() for c in ("xml_summary", "name", "fqn", "canonical_key", "signature", "kind")]
            judged = [judge(*row) for row in zip(*read)]
            out = {c: batch[c] for c in ("id", "container_id", "name", "fqn", "kind", "signature")}
            out |= {"state": pa.array([j[0] for j in judged], pa.string()), "text": pa.array([j[1] for j in judged], pa.string()), "added_at": batch["added_at"]}
            yield pa.RecordBatch.from_pydict(out)

    return live.select(*columns).mapInArrow(run, _JUDGED)


def _one_row(judged: DataFrame) -> DataFrame:
    """One row per id: of several live rows the one that is a pair, then the one added last."""
    usable = (F.col("state") == "own") & F.coalesce(F.col("signature").rlike(SIGNED), F.lit(False))
    order = F.struct(usable, F.col("state") == "own", F.col("state") == "inherits", F.col("added_at").isNotNull(), "added_at", "signature", "text")
    row = F.struct("container_id", "name", "fqn", "kind", "signature", "state", "text")
    return judged.groupBy("id").agg(F.max_by(row, order).alias("r")).select("id", "r.*")


def _ancestors(types: DataFrame, inherits: DataFrame) -> DataFrame:
    """(container_id, dst, distance): every base type of the types at its least distance, level by
    level until a level has nothing new, so circles end."""
    links = inherits.withColumnRenamed("src", "via")
    frontier = cut(types.join(links.withColumnRenamed("via", "container_id"), "container_id").select("container_id", "dst", F.lit(1).alias("distance")))
    seen, distance = frontier, 1
    while not frontier.isEmpty():
        distance += 1
        step = frontier.select("container_id", F.col("dst").alias("via")).join(links, "via").select("container_id", "dst").filter(F.col("dst") != F.col("container_id")).distinct()
        frontier = cut(step.join(seen.select("container_id", "dst"), ["container_id", "dst"], "left_anti").withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(frontier)
    return seen


def overridden(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, base, rank, distance): for functions that inherit their text, every function they may
    take it from: the named target and its overloads (rank 0), the functions that inherits edges lead
    to (1), the functions of the same name in base types, near or far (2)."""
    wanting = functions.filter("state = 'inherits'").select("id", "container_id", "name", "text")
    lending = functions.filter("state in ('own', 'inherits')")
    inherits = cut(edges.filter((normal_kind("kind_name") == "inherits") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    ids = F.sort_array(F.collect_set("id")).alias("ids")
    by_name = lending.groupBy("container_id", "name").agg(ids)
    by_fqn = lending.filter("fqn is not null").groupBy("fqn").agg(ids)
    named = wanting.filter("text != ''").select("id", F.regexp_replace("text", r"^[A-Z]:|\(.*$", "").alias("fqn"))
    named = skew_join(named, by_fqn, ["fqn"], ["id"], "inner").select("id", F.explode("ids").alias("base"), F.lit(0).alias("rank"), F.lit(0).alias("distance"))
    known = lending.select(F.col("id").alias("base"))
    direct = wanting.join(inherits.withColumnRenamed("src", "id"), "id").select("id", F.col("dst").alias("base"))
    direct = direct.join(known, "base", "left_semi").select("id", "base", F.lit(1).alias("rank"), F.lit(1).alias("distance"))
    # the pairs of a derived and a base type meet the functions of the derived type, then the base's
    types = _ancestors(wanting.select("container_id").distinct(), inherits).groupBy("container_id").agg(F.sort_array(F.collect_set(F.struct("dst", "distance"))).alias("bases"))
    through = skew_join(wanting.select("id", "container_id", "name"), types, ["container_id"], ["id"], "inner")
    through = through.select("id", "name", F.explode("bases").alias("b")).select("id", "name", F.col("b.dst").alias("container_id"), "b.distance")
    through = skew_join(through, by_name, ["container_id", "name"], ["id"], "inner").select("id", F.explode("ids").alias("base"), F.lit(2).alias("rank"), "distance")
    every = named.unionByName(direct).unionByName(through).filter("id != base")
    return every.groupBy("id", "base").agg(F.min(F.struct("rank", "distance")).alias("r")).select("id", "base", "r.*")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least levels of all functions that (id, base, base_level) lead to a base with a level from."""
    takers: dict[int, list[int]] = {}
    queue: list[tuple[int, int]] = []
    for batch in batches:
        for taker, base, level in zip(*(batch[c].to_pylist() for c in ("id", "base", "base_level"))):
            if level is None:
                takers.setdefault(base, []).append(taker)
            else:
                queue.append((level + 1, taker))
    heapq.heapify(queue)
    done: dict[int, int] = {}
    while queue:
        level, at = heapq.heappop(queue)
        if at not in done:
            done[at] = level
            for taker in takers.get(at, ()):
                heapq.heappush(queue, (level + 1, taker))
    yield pa.RecordBatch.from_pydict({"id": pa.array(list(done), pa.int64()), "level": pa.array(list(done.values()), pa.int32())})


def _levels(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, level): functions that have text at level 0, those with a base of level n - 1 at n, each
    at its least.  A function at level n has one at each smaller level above it, so a round that
    finds none is the last: what is left has only circles and bases without text.  Each round joins
    all open candidates; once few are left (OPEN_ROWS), one task follows them to the end, however
    long their chains are."""
    seen = frontier = cut(own.select("id", F.lit(0).alias("level")))
    for level in itertools.count(1):
        met = skew_join(candidates.select("id", "base"), frontier.select(F.col("id").alias("base")), ["base"], ["id"], "inner").select("id").distinct()
        frontier = cut(met.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if level < ROUNDS_FIRST:
            continue
        candidates = cut(candidates.join(seen, "id", "left_anti").select("id", "base"))
        if candidates.count() <= OPEN_ROWS:
            levels = seen.select(F.col("id").alias("base"), F.col("level").alias("base_level"))
            rest = candidates.join(levels, "base", "left").select("id", "base", "base_level").coalesce(1).mapInArrow(_follow, "id long, level int")
            return seen.unionByName(cut(rest))


def _ends(chosen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follow (id, base) to the functions that choose none.  Gives (id, end), and (id) of those
    on circles, if any.  Each round doubles the steps; one that ends none leaves only circles, and
    after as many steps as there are functions left, they all stand on them."""
    chosen = cut(chosen)
    choosers = chosen.select(F.col("id").alias("base"), F.col("base").alias("next"))
    done, open_, steps = None, chosen, 1
    while True:
        met = cut(skew_join(open_, choosers, ["base"], ["id"], "left"))
        ended = met.filter("next is null").select("id", F.col("base").alias("end"))
        done = ended if done is None else done.unionByName(ended)
        left = met.filter("next is not null").select("id", F.col("next").alias("base"))
        n = left.count()
        if not n:
            return done, None
        steps *= 2
        if ended.isEmpty() and steps > n:
            return done, left.select(F.col("base").alias("id")).distinct()
        open_ = left
        choosers = left.select(F.col("id").alias("base"), F.col("base").alias("next")).unionByName(done.select(F.col("id").alias("base"), F.col("end").alias("next")))


def pair_documentation(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, signature, documentation, source, documented_by): code-description pairs.

    source is 'own' or 'inherited'; documented_by is the function whose text it is.  Functions with
    a null or blank signature, with trivial documentation, or whose inherited documentation stays
    unresolved (no base, bases without text, circles only) are left out.  First it is found which
    functions can have text at all; then each takes the best base that can (by rank, distance and
    id).  Where such choices run in a circle, the functions on it choose again among the bases of a
    lower level; those can't make a circle by themselves, so this ends.
    """
    functions = cut(_one_row(judge_symbols(symbols)))
    signed = F.col("signature").rlike(SIGNED)
    candidates = cut(overridden(functions, edges))
    own = functions.filter("state = 'own'").select("id", F.col("text").alias("documentation"), F.col("id").alias("documented_by"))
    levels = cut(_levels(own, candidates))
    usable = skew_join(candidates, levels.select(F.col("id").alias("base"), F.col("level").alias("base_level")), ["base"], ["id"], "inner")
    usable = cut(usable.join(levels, "id"))
    best = F.min_by("base", F.struct("rank", "distance", "base")).alias("base")
    chosen = cut(usable.groupBy("id").agg(best))
    while True:
        ends, circles = _ends(chosen)
        if circles is None:
            break
        again = usable.filter("base_level < level").join(circles, "id", "left_semi").groupBy("id").agg(best)
        chosen = cut(chosen.join(circles, "id", "left_anti").unionByName(again))
    texts = own.select(F.col("id").alias("end"), "documentation", "documented_by")
    taken = skew_join(ends, texts, ["end"], ["id"], "inner").select("id", "documentation", "documented_by")
    inherited = functions.filter(signed & (F.col("state") == "inherits")).select("id", "kind", "signature").join(taken, "id")
    said = functions.filter(signed & (F.col("state") == "own")).select("id", "kind", "signature", F.col("text").alias("documentation"), F.col("id").alias("documented_by"))
    columns = ["id", "kind", "signature", "documentation", "source", "documented_by"]
    return said.withColumn("source", F.lit("own")).unionByName(inherited.withColumn("source", F.lit("inherited"))).select(*columns)


def find_documented(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """ids of functions whose own documentation isn't trivial: of all resolved pairs those that each
    function documents by itself (a statement beside an inheriting tag is its own; text that is only
    inherited doesn't count here)."""
    return pair_documentation(symbols, edges).filter(F.col("documented_by") == F.col("id")).select("id").distinct()
