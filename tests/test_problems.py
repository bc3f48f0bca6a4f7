"""Orphans, hierarchies and skewed keys against brute force, with nulls, ties, repeats, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import balance, hierarchy, orphans, skew

T = dt.datetime
REF = "scope_id string, id long, symbol_id long, file_id long, line int, col int, kind int, seen_at timestamp_ntz, name string"
SYM = "scope_id string, id long, file_id long, container_id long, name string, added_at timestamp_ntz, deleted_at timestamp_ntz, key long"
FILE = "scope_id string, id long, path string, added_at timestamp_ntz, deleted_at timestamp_ntz"
SHARED = "id long, name string"


@pytest.fixture(autouse=True)
def split_small_keys(monkeypatch):
    monkeypatch.setattr(balance, "LEAST_HEAVY", 100)


def frames(spark, refs=(), symbols=(), files=(), shared=()):
    return [spark.createDataFrame(list(r), s) for r, s in ((refs, REF), (symbols, SYM), (files, FILE), (shared, SHARED))]


def test_orphan_reasons(spark):
    jan, feb = T(2025, 1, 10), T(2025, 2, 10)
    refs = [
        ("a", 1, 10, 100, 1, 1, 0, jan, "x"),  # good
        ("a", 1, 10, 100, 1, 1, 0, jan, "x"),  # exact copy
        ("a", 2, 11, 100, 1, 1, 0, jan, None),  # late symbol
        ("a", 2, 11, 100, 1, 1, 0, feb, None),  # sent again, in time
        ("a", 3, 12, None, 1, 1, 0, jan, None),  # symbol deleted after the month, null file
        ("a", 4, 0, -1, 1, 1, 0, jan, None),  # zero and negative are judged
        ("b", 5, 10, 100, 1, 1, 0, jan, None),  # other scope
        ("b", 6, 7, 100, 1, 1, 0, jan, None),  # shared symbol, from any scope
        ("a", 7, 13, 100, 1, 1, 0, jan, None),  # deleted and back later
        ("a", 8, 12, 100, 1, 1, 0, feb, None),  # deleted in the month of the reference
    ]
    symbols = [
        ("a", 10, 100, None, "n", jan, None, 1), ("a", 11, 100, None, "n", T(2025, 2, 1), None, 1), ("a", 12, 999, None, "n", jan, feb, 1),
        ("a", 13, 100, None, "n", jan, jan, 1), ("a", 13, 100, None, "n", T(2025, 1, 31, 23), None, 1), ("a", 14, 999, None, "n", feb, None, 1),
    ]
    got = {tuple(r) for r in orphans.find_orphans(*frames(spark, refs, symbols, [("a", 100, "p", jan, None)], [(7, "s")])).collect()}
    assert got == {
        ("refs", "symbol_id", 2, "2025-01", "late"), ("refs", "symbol_id", 3, "2025-01", "deleted-later"), ("refs", "symbol_id", 8, "2025-02", "deleted"), ("refs", "symbol_id", 4, "2025-01", "missing"), ("refs", "file_id", 4, "2025-01", "missing"),
        ("refs", "symbol_id", 5, "2025-01", "missing"), ("refs", "file_id", 5, "2025-01", "missing"), ("refs", "file_id", 6, "2025-01", "missing"), ("symbols", "file_id", 14, "2025-02", "missing"),
    }


def test_orphans_of_empty_tables(spark):
    assert orphans.find_orphans(*frames(spark)).count() == 0
    jan = T(2025, 1, 1)
    only = orphans.find_orphans(*frames(spark, refs=[("a", 1, 2, None, 1, 1, 0, jan, "x"), (None, 2, 2, None, 1, 1, 0, None, "x")])).collect()
    assert {(r.row_id, r.period, r.reason) for r in only} == {(1, "2025-01", "missing"), (2, None, "missing")}


def test_hot_orphan_key_is_split(spark):
    rng = random.Random(1)
    month = T(2025, 3, 5)
    refs = [("a", k, 5 if k % 3 else rng.randrange(50), None, 1, 1, 0, month, None) for k in range(3000)]
    symbols = [("a", k, None, None, "n", month, None, 1) for k in range(0, 50, 2)]
    pointer_rows, intervals = orphans.code_graph_pointers(*frames(spark, refs, symbols))
    plan = balance.plan_placement(pointer_rows, orphans.KEYS, 4)
    assert plan.heavy and len(plan.heavy[0][1]) > 1  # the hot key has several shards
    assert max(plan.loads) < 0.4 * sum(plan.loads)
    got = {r.row_id for r in orphans.merge_pointers(pointer_rows, intervals, 4).filter("reason is not null").collect()}
    assert got == {k for _, k, s, *_ in refs if s % 2}


def test_placement_reaches_every_match(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(100)]), k) for k in range(2000)], "k long, v long")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 100, 3)], "k long, name string")
    got = sorted((r.k or -1, r.v, r.name or "") for r in balance.skew_join(left, right, ["k"], ["v"]).collect())
    want = sorted((r.k or -1, r.v, r.name or "") for r in left.join(right, "k", "left").collect())
    assert got == want
    tokens = balance.partition_tokens(7)
    rows = spark.createDataFrame([(t,) for t in tokens], "t int").repartition(7, "t").select("t", F.spark_partition_id().alias("p")).collect()
    assert {r.t: r.p for r in rows} == {t: k for k, t in enumerate(tokens)}


def brute_forest(parents):
    out = {}
    for v in parents:
        seen, at = [], v
        while at is not None and at in parents and at not in seen:
            seen.append(at)
            at = parents[at]
        out[v] = (None, min(seen[seen.index(at) :])) if at in seen else (tuple(reversed(seen)), None)
    return out


@pytest.mark.parametrize("shape, few", [("chain", 500_000), ("star", 500_000), ("cycle", 500_000), ("any", 500_000), ("any", 0)])
def test_hierarchy_shapes(spark, monkeypatch, shape, few):
    monkeypatch.setattr(hierarchy, "FEW_EXITS", few)
    rng = random.Random(shape)
    ids = rng.sample(range(5000), 300)
    parents = {}
    for k, v in enumerate(ids):
        parents[v] = {"chain": ids[k - 1] if k else None, "star": ids[0] if k else None, "cycle": ids[k - 1], "any": rng.choice([*ids, None, -5])}[shape]
    nodes = spark.createDataFrame([(a, b, None if a % 7 == 0 else f"n{a}") for a, b in parents.items()], "id long, parent long, name string")
    solved = hierarchy.resolve_hierarchy(nodes, task_rows=70)
    got = {r.id: (tuple(r.ancestors) if r.ancestors is not None else None, r.cycle_id, r.depth, r.root_id, r.path) for r in solved.collect()}
    for v, (chain, cycle) in brute_forest(parents).items():
        names = None if chain is None else [None if a % 7 == 0 else f"n{a}" for a in chain]
        assert got[v] == (chain, cycle, None if chain is None else len(chain) - 1, chain and chain[0], names)
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in hierarchy.descendants(solved).collect()} if shape != "chain" else None
    if pairs is not None:
        assert pairs == {(a, v, len(c) - 1 - k) for v, (c, _) in brute_forest(parents).items() if c for k, a in enumerate(c[:-1])}


def test_hierarchy_rows_and_empty(spark):
    now = T(2025, 1, 1)
    rows = [("a", 1, None, 1, "self", now, None, 0), ("a", 2, None, 3, "two", now, None, 0), ("a", 2, None, 3, "two", now, None, 0), ("a", 3, None, 9, "dead parent", now, None, 0), ("a", 9, None, None, "dead", now, now, 0), ("a", 4, None, 1, "below", now, None, 0)]
    symbols = spark.createDataFrame(rows, SYM)
    assert {tuple(r) for r in hierarchy.find_cycles(symbols).collect()} == {(1, 1), (4, 1)}
    solved = {r.id: r.path for r in hierarchy.resolve_hierarchy(hierarchy.live_nodes(symbols)).collect()}
    assert solved == {1: None, 4: None, 3: ["dead parent"], 2: ["dead parent", "two"]}
    assert hierarchy.find_cycles(symbols.limit(0)).count() == 0


def test_skewed_counts(spark):
    refs = [("a", k % 900, 5 if k % 2 else k % 40, None, 1, 1, 0, None, None) for k in range(2000)] + [("a", 1, None, None, 1, 1, 0, None, None)]
    refs, symbols, _, shared = frames(spark, refs, [("a", 5, None, None, "five", None, None, 0), ("a", 77, None, None, "idle", None, None, 0)], (), [(6, "six")])
    got = {r.symbol_id: (r.name, r.n) for r in skew.reference_loads(refs, symbols, shared).collect()}
    want = {}
    for k in range(2000):
        want.setdefault(5 if k % 2 else k % 40, set()).add(k % 900)
    names = {5: "five", 6: "six", 77: "idle"}
    assert got == {k: (names.get(k), len(want.get(k, ()))) for k in {*want, *names}}


def test_heavy_symbols_normalise_kinds(spark):
    edges = spark.createDataFrame([("a", k, 9, " Calls", None) for k in range(60)] + [("a", 1, 9, "CALLS", "{}"), ("a", 2, 8, "uses_type", None), ("a", None, 8, "calls", None), ("b", 1, 9, "calls", None)] + [("a", k, k, "calls", None) for k in range(100, 200)], "scope_id string, src long, dst long, kind_name string, payload string")
    refs, symbols, _, shared = frames(spark)
    found = {tuple(r) for r in skew.find_heavy(refs, edges, symbols, shared).collect()}
    assert found == {("calls", 9)}
