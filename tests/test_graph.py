"""Graph operators on small seeds: traversal, tracing, lookups, views, merges, ad-hoc SQL, rules."""

import pytest
from pyspark.sql import functions as F

from codeloom import adhoc, admin
from codeloom.functions import format as fmt
from codeloom.functions.keys import accessibility_code, edge_kind, is_canonical_key, require_intent
from codeloom.operators import aggregate, interop, lookup, merge, payload, rpc, search, trace, traversal, ui
from codeloom.plans import tools
from codeloom.tables import SCHEMAS, empty_tables, load_tables, save_tables
from codeloom.views import catalog, register_views, v_edge_evidence, v_references, v_symbols


def seed(spark, edges, no_evidence=(), payloads=None):
    """A scope whose symbols are the edges' names; edges: (src, dst, line, confidence, kind)."""
    names = sorted({x for e in edges for x in e[:2]})
    ids = {n: k + 1 for k, n in enumerate(names)}
    symbols = [("s", i, f"csharp:M:{n}", n, f"App.{n}", "method", 1, i, 1, i + 5, 1, f"void {n}()", None, None, 6, f"Documents {n}.", None) for n, i in ids.items()]
    logical = [("s", ids[a], ids[b], k, (payloads or {}).get((a, b))) for a, b, _, _, k in edges]
    proof = [("s", n, ids[a], ids[b], k, 1, "/a.cs", line, 1, line, 9, c, "compiler", "") for n, (a, b, line, c, k) in enumerate(edges) if (a, b) not in no_evidence]
    t = empty_tables(
        spark, files=spark.createDataFrame([("s", 1, "/a.cs", b"1", 1, 0), ("s", 2, "/g.cs", b"2", 1, 1)], SCHEMAS["files"]), symbols=spark.createDataFrame(symbols, SCHEMAS["symbols"]),
        edges=spark.createDataFrame(logical, SCHEMAS["edges"]), edge_evidence=spark.createDataFrame(proof, SCHEMAS["edge_evidence"]), scopes=spark.createDataFrame([("s", "S", "/s", 0, 1, "ready", None), ("v", "V", "/v", 1, 1, "ready", None)], SCHEMAS["scopes"]),
    )
    return t, ids


def at(spark, *ids):
    return spark.createDataFrame([("s", i) for i in ids], "scope string, id long")


CALLS = [("A", "B", 1, 2, "calls"), ("B", "C", 2, 1, "calls"), ("A", "D", 3, 2, "calls"), ("D", "C", 4, 2, "calls"), ("C", "A", 5, 2, "calls")]


def test_trace_finds_simple_paths_in_a_circle(spark):
    t, ids = seed(spark, CALLS)
    done = trace.trace_paths(t, at(spark, ids["A"]), at(spark, ids["C"]), trace.relation("calls"))
    got = {(tuple(r.path_ids), r.confidence) for r in done.paths.collect()}
    assert got == {((ids["A"], ids["B"], ids["C"]), 1), ((ids["A"], ids["D"], ids["C"]), 2)}
    assert done.absence_authoritative
    cut = trace.trace_paths(t, at(spark, ids["A"]), at(spark, ids["C"]), trace.relation("calls"), max_nodes=2)
    assert cut.truncated and not cut.absence_authoritative


def test_trace_reports_paths_that_a_cap_cuts(spark):
    t, ids = seed(spark, CALLS)
    ends = at(spark, ids["A"]), at(spark, ids["C"]), trace.relation("calls")
    done = trace.trace_paths(t, *ends, max_paths=1)
    assert done.paths.count() == 1 and done.truncated and not done.absence_authoritative
    t, ids = seed(spark, CALLS + [("C", "T", 9, 2, "tests"), ("D", "T", 9, 2, "uses-type")])
    whole = trace.every_path(t, at(spark, ids["A"]), trace.Automaton("p", "q", (("p", "calls", "p"), ("p", "tests", "q")))).collect()
    assert {("".join(sorted(ids)[i - 1] for i in r.path_ids), r.confidence, r.n_hops, r.kinds[-1]) for r in whole} == {("ABCT", 1, 3, "tests"), ("ADCT", 2, 3, "tests")}


def simple_paths(edges, goals, depth):
    """Simple paths of up to ``depth`` hops that meet a goal at their end and, but for the start, only there."""
    out, level = set(), [(a,) for a in {e[0] for e in edges}]
    for _ in range(depth):
        level = [p + (b,) for p in level for a, b in {e[:2] for e in edges} if a == p[-1] and b not in p]
        out |= {p for p in level if p[-1] in goals}
        level = [p for p in level if p[-1] not in goals]
    return out


def test_paths_into_targets_come_from_every_source(spark):
    many = [(f"K{k}", "A", 10 + k, 2, "calls") for k in range(45)] + [("X", "X", 90, 2, "calls"), ("X", "K7", 91, 2, "calls"), ("Y", "C", 92, 2, "tests")]
    chain = [(f"L{k}", f"L{k + 1}", 100 + k, 2, "calls") for k in range(9)] + [("L9", "C", 110, 2, "calls")]
    t, ids = seed(spark, CALLS + many + chain, no_evidence={("K3", "A")})
    calls = [e for e in CALLS + many + chain if e[4] == "calls" and e[:2] != ("K3", "A")]
    for goals in ({"C"}, {"C", "K7"}):
        found = trace.paths_into(t, t.symbols.select("scope", "id"), at(spark, *[ids[g] for g in goals])).collect()
        assert sorted(tuple(r.path_ids) for r in found) == sorted(tuple(ids[x] for x in p) for p in simple_paths(calls, goals, 8))
        assert all(r.n_hops == len(r.kinds) == len(r.path_ids) - 1 and r.ends_at == r.path_ids[-1] for r in found)
        weak = (ids["B"], ids["C"])
        assert all(r.confidence == (1 if weak in zip(r.path_ids, r.path_ids[1:]) else 2) for r in found)
    assert trace.paths_into(t, at(spark, ids["C"]), at(spark, ids["X"])).count() == 0


def test_edges_without_evidence_leave_before_the_cap(spark):
    t, ids = seed(spark, [("S", "A", 1, 2, "calls"), ("S", "Z", 2, 2, "calls")], no_evidence={("S", "A")})
    assert [r.dst for r in traversal.adjacent(t, at(spark, ids["S"]), "calls", False, True, 1).collect()] == [ids["Z"]]
    assert [r.dst for r in traversal.adjacent(t, at(spark, ids["S"]), "calls", False, False, 9).collect()] == [ids["A"], ids["Z"]]


CHAIN = [("Ui", "Command", "binds-path"), ("Command", "Handler", "command-executes"), ("Handler", "Service", "calls"), ("Service", "Helper", "calls"), ("Helper", "Rpc", "grpc-calls"), ("Rpc", "Server", "rpc-dispatches-to"), ("Server", "Import", "calls"), ("Import", "Export", "pinvoke-maps-to"), ("Export", "Native", "calls")]


def test_execution_profile_accepts_the_order_only(spark):
    edges = [(a, b, k, 2, kind) for k, (a, b, kind) in enumerate(CHAIN)]
    decoys = [("Ui", "Native", 50, 2, "tests"), ("Handler", "Export", 51, 2, "pinvoke-maps-to"), ("Server", "Rpc", 52, 2, "grpc-calls")]
    t, ids = seed(spark, edges + decoys)
    done = trace.trace_paths(t, at(spark, ids["Ui"]), None, trace.EXECUTION, max_depth=12).paths.collect()
    assert [r.path_ids for r in done] == [[ids[CHAIN[0][0]]] + [ids[b] for _, b, _ in CHAIN]]
    assert done[0].n_hops == 9 and done[0].kinds == [k for *_, k in CHAIN]


def test_impact_orders_and_bounds(spark):
    t, ids = seed(spark, CALLS)
    rows = {r.id: r for r in traversal.impact_of_change(t, at(spark, ids["C"])).collect()}
    assert {i: r.depth for i, r in rows.items()} == {ids["B"]: 1, ids["D"]: 1, ids["A"]: 2}
    assert rows[ids["A"]].predecessor == ids["B"] and rows[ids["A"]].path_ids == [ids["C"], ids["B"], ids["A"]] and rows[ids["A"]].confidence == 1
    levels = {r.id: r.depth for r in traversal.impact_levels(t, at(spark, ids["C"])).collect()}
    assert levels == {ids["B"]: 1, ids["D"]: 1, ids["A"]: 2, ids["C"]: 3}  # the target again, through the circle
    assert traversal.impact_of_change(t, at(spark, ids["C"]), limit=1).count() == 1
    with pytest.raises(ValueError):
        traversal.impact_of_change(t, at(spark, ids["C"]), max_depth=13)


def test_find_definition_narrows_after_the_limit(spark):
    t, ids = seed(spark, [("Run", "RunAll", 1, 2, "calls"), ("Runner", "Run", 1, 2, "calls")])
    assert [r.name for r in lookup.find_definition(t, "App.Run").collect()] == ["Run"]
    assert [r.name for r in lookup.find_definition(t, "run").collect()] == ["Run", "RunAll", "Runner"]
    assert [r.name for r in lookup.find_definition(t, "csharp:M:Run").collect()] == ["Run"]
    assert lookup.find_definition(t, "csharp:M:Ru").count() == 0  # an exact key never turns fuzzy
    with pytest.raises(ValueError):
        lookup.find_definition(t, "csharp:")
    assert tools.call("find_symbol", t, scope="s", query="run").count() == 3
    assert tools.call("impact_analysis", t, default="s", symbol="App.Run").count() == 1


def test_keys_and_kinds():
    assert is_canonical_key("ts:M:a.b") and not is_canonical_key("ts:M") and not require_intent("Foo.Bar")
    assert edge_kind(" USES_TYPE ") == "uses-type" and edge_kind("*") is None and edge_kind("overrides") == "overrides-member"
    with pytest.raises(ValueError):
        edge_kind("nope", {"calls"})
    assert accessibility_code("Protected_Internal") == 5 and accessibility_code(None) is None


def test_views_map_codes(spark):
    t, ids = seed(spark, CALLS)
    assert {r.confidence for r in v_edge_evidence(t).collect()} == {"semantic", "exact"}
    refs = spark.createDataFrame([("s", k, 1, 1, 1, 1, k) for k in (0, 6, 9)], SCHEMAS["refs"])
    assert {r.kind for r in v_references(t.with_tables(refs=refs)).collect()} == {"def", "write", "9"}
    assert {(r.is_public, r.is_type) for r in v_symbols(t).collect()} == {(1, 0)}
    assert catalog(t).filter("view_name = 'v_edges'").count() == 5


def test_search_is_by_fragment_of_three(spark):
    t, ids = seed(spark, [("OpenDoor", "CloseDoor", 1, 2, "calls"), ("Wait", "OpenDoor", 1, 2, "calls")])
    assert {r.name for r in search.search_symbols(t, "doOR").collect()} == {"OpenDoor", "CloseDoor"}
    assert search.search_symbols(t, "do").count() == 0 and search.search_symbols(t, "%oo").count() == 0
    texts = {r.text for r in search.embedding_text(t).collect()}
    assert "method App.Wait\nDocuments Wait.\nvoid Wait()" in texts


def test_payload_values(spark):
    edges = [("A", "B", 1, 2, "binds-path"), ("A", "C", 1, 2, "binds-path"), ("A", "D", 1, 2, "binds-path")]
    t, ids = seed(spark, edges, payloads={("A", "B"): '{"path":"Items.Name","mode":"TwoWay"}', ("A", "C"): '{"path":', ("A", "D"): ""})
    assert [(r.dst_fqn, r.mode) for r in payload.find_data_bindings(t, path="Items").collect()] == [("App.B", "TwoWay")]
    assert payload.find_data_bindings(t, path="items").count() == 0
    assert payload.has_payload_key(t, "binds-path", "mode") and not payload.has_payload_key(t, "calls", "mode")
    assert ui.trace_binding(t, binding="Items").first().status == "not-found"
    mark = spark.createDataFrame([("s", 1, ids["A"], "n", "n", ui.OUTCOME, '{"status":"Resolved"}', None)], SCHEMAS["annotations"])
    assert {r.status for r in ui.trace_binding(t.with_tables(annotations=mark), element="A").collect()} == {"resolved"}


def test_blame_takes_the_newest_line(spark):
    spans = spark.createDataFrame([("s", 1, 1, 2, 900), ("s", 2, 1, 800, 900)], "scope string, symbol_id long, file_id long, start_line int, end_line int")
    lines = spark.createDataFrame([("s", 1, k, f"c{k}", "a", 5 if k in (3, 4) else 1) for k in range(1, 601)], "scope string, file_id long, line int, sha string, author string, authored_at long")
    rows = aggregate.blame_spans(spans, lines).collect()
    assert [(r.symbol_id, r.last_commit_sha, r.line_count) for r in rows] == [(1, "c3", 599)]


def test_edges_and_evidence_merge(spark):
    t, ids = seed(spark, CALLS)
    new = spark.createDataFrame([("s", ids["A"], ids["C"], "calls", "p")], SCHEMAS["edges"])
    once = merge.insert_edges(t, new, t.edge_evidence.limit(0))
    legacy = once.edge_evidence.filter("producer = 'legacy-declaration'").collect()
    assert [(r.src, r.dst, r.confidence, r.payload) for r in legacy] == [(ids["A"], ids["C"], 0, "p")]
    twice = merge.insert_edges(once, new, t.edge_evidence.limit(0))
    assert twice.edges.count() == once.edges.count() and twice.edge_evidence.count() == once.edge_evidence.count()
    cleared = merge.clear_producer(once, "compiler", scope="s")
    assert merge.clear_producer(once, "compiler", scope="v").edge_evidence.count() == once.edge_evidence.count()
    with pytest.raises(ValueError):
        merge.clear_producer(once, "compiler")
    assert [(r.src, r.dst) for r in cleared.edges.collect()] == [(ids["A"], ids["C"])]


def test_replacing_twice_is_replacing_once(spark):
    t, ids = seed(spark, CALLS)
    row = ("s", "csharp:M:B", "csharp:M:D", "calls", 1, "/a.cs", 7, 1, 7, 9, 2, "x")
    schema = "scope string, src_key string, dst_key string, kind_name string, producing_file_id long, file_path string, start_line int, start_col int, end_line int, end_col int, confidence int, payload string"
    facts = spark.createDataFrame([row], schema)
    once = merge.replace_producer(t, "rules", facts, scope="s")
    twice = merge.replace_producer(once, "rules", facts, scope="s")
    show = lambda x: sorted(tuple(r) for r in x.edges.collect())
    assert show(once) == show(twice) and ("s", ids["B"], ids["D"], "calls", "x") in show(once)
    assert show(merge.replace_producer(once, "rules", facts.limit(0), scope="s")) == show(t)
    with pytest.raises(merge.UnresolvedEndpoint):
        merge.replace_producer(t, "rules", facts.withColumn("dst_key", F.lit("csharp:M:Nobody")), scope="s")
    with pytest.raises(merge.UnresolvedEndpoint):
        merge.replace_producer(t, "rules", facts, scope="v")


def test_deleting_a_file_cascades(spark):
    t, ids = seed(spark, CALLS)
    gone = merge.delete_files(t, spark.createDataFrame([("s", 1)], "scope string, file_id long"))
    assert gone.files.count() == 1 and gone.symbols.count() == 0 and gone.edges.count() == 0 and gone.edge_evidence.count() == 0


def test_facts_of_a_file_are_replaced(spark):
    t, ids = seed(spark, CALLS)
    files = spark.createDataFrame([("s", "/a.cs", b"9", 5, 0)], "scope string, path string, content_sha256 binary, last_indexed_at long, is_generated int")
    shape = "scope string, path string, canonical_key string, name string, fqn string, kind_name string, start_line int, start_col int, end_line int, end_col int, signature string, modifiers string, accessibility int, xml_summary string, test_framework string, container_key string"
    rows = [("s", "/a.cs", f"csharp:M:{n}", n, f"App.{n}", "method", 1, 1, 2, 1, None, None, 6, None, None, box) for n, box in (("A", None), ("E", "csharp:M:A"))]
    edges = spark.createDataFrame([("s", "csharp:M:A", "csharp:M:E", "calls", "/a.cs", 1, 1, 1, 2, 2, "compiler", "")], "scope string, src_key string, dst_key string, kind_name string, file_path string, start_line int, start_col int, end_line int, end_col int, confidence int, producer string, payload string")
    marks = spark.createDataFrame([("s", "csharp:M:E", "Test", "Test", "test", "[]")], "scope string, symbol_key string, name string, full_name string, flavor string, args_json string")
    refs = spark.createDataFrame([("s", "csharp:M:A", "/a.cs", 3, 1, 2)], "scope string, symbol_key string, path string, line int, col int, kind int")
    new = merge.replace_file_facts(t, files, spark.createDataFrame(rows, shape), edges, marks, refs)
    symbols = {r.name: r for r in new.symbols.collect()}
    assert set(symbols) == {"A", "E"} and symbols["A"].id == ids["A"] and symbols["E"].container_id == ids["A"]
    assert [(r.src, r.dst) for r in new.edges.collect()] == [(ids["A"], symbols["E"].id)]
    assert new.annotations.count() == 1 and new.refs.first().symbol_id == ids["A"]


def test_snapshots_move_a_pointer(spark, tmp_path):
    t, ids = seed(spark, CALLS)
    store = merge.SnapshotStore(spark, str(tmp_path / "graph"))
    assert store.current() == 0
    assert store.publish(t) == 1
    broken = t.with_tables(edges=t.edges.unionByName(spark.createDataFrame([("s", 99, 1, "calls", None)], SCHEMAS["edges"])))
    assert store.publish(broken, expected=1) == 2
    with pytest.raises(RuntimeError):
        store.publish(t, expected=1)
    assert {r["check"]: r.n_rows for r in merge.integrity(store.read()).collect()}["edges.src"] == 1
    assert admin.repair_scope(store) == 3 and store.read().edges.count() == len(CALLS)
    assert admin.repair_scope(store, "rebuild") == 1 and store.current() == 1
    assert store.publish(t) == 4 and store.read(2).edges.count() == len(CALLS) + 1  # no number is used again
    with pytest.raises(FileNotFoundError):
        store.read(99)
    (tmp_path / "graph/pointers/000000000099.json").write_text('{"version":')  # a writer that died at its pointer
    (tmp_path / "graph/v=7").mkdir()  # and one that died at its tables
    assert store.current() == 4 and store.publish(t) == 8 and store.current() == 8
    late = merge.SnapshotStore(spark, str(tmp_path / "graph"))
    seen = late._pointer()
    store.publish(t)
    late._pointer = lambda: seen  # it read the pointer before the other published
    with pytest.raises(RuntimeError):
        late._point(max(store._pointers()) - 1, 1, {})
    save_tables(t, str(tmp_path / "plain"))
    assert load_tables(spark, str(tmp_path / "plain")).edges.count() == len(CALLS)
    changes, _ = admin.reconcile_drift(t, t.files.filter("id = 1").select("scope", "path", "content_sha256"), dry_run=True)
    assert [(r.path, r.change) for r in changes.collect()] == [("/g.cs", "removed")]


@pytest.mark.parametrize("sql, code", [("DELETE FROM v_edges", "read_only"), ("/* x */ drop view v_edges", "read_only"), ("SELECT 1; SELECT 2", "multi_statement"), ("", "read_only"), ("SELECT nope FROM v_edges", "sql")])
def test_adhoc_errors(spark, sql, code):
    t, _ = seed(spark, CALLS)
    with pytest.raises(adhoc.QueryError) as caught:
        adhoc.query_graph(spark, t, sql)
    assert caught.value.code == code


def test_adhoc_results(spark):
    t, ids = seed(spark, CALLS)
    out = adhoc.query_graph(spark, t, "-- ; a comment\nSELECT ';' AS s, count(*) AS n FROM v_edges WHERE kind = @k; -- end", {"k": "calls"}, timeout_s=120)
    assert out.rows == [(";", 5)] and out.columns == [("s", "string"), ("n", "bigint")] and not out.truncated
    cut = adhoc.query_graph(spark, t, "SELECT src FROM v_edges", row_cap=2, timeout_s=120)
    assert len(cut.rows) == 2 and cut.truncated and cut.scopes == ["s"]
    assert adhoc.resolve_scopes(t, "v") == ["v"]
    for scope, code in (("zzz", "unknown_scope"), (None, "unknown_scope")):
        with pytest.raises(adhoc.QueryError) as caught:
            adhoc.resolve_scopes(t, scope)
        assert caught.value.code == code
    assert "v_symbols" in adhoc.describe_schema(t)["views"]
    ago = adhoc.query_graph(spark, t, "SELECT strftime('%s', 'now') - strftime('%s','now','-2 days') AS a, json_extract('{\"n\":69}', '$.n') = 69 AS b FROM v_scopes LIMIT 1", timeout_s=120)
    assert 172_799 <= ago.rows[0][0] <= 172_801 and ago.rows[0][1]
    assert adhoc.query_graph(spark, t, "SELECT count(*) FROM v_symbols WHERE name = 'a' COLLATE NOCASE", timeout_s=120).rows == [(1,)]


def facts(spark, **export):
    none = f"array<{interop.PARAM}>"
    target = "rid string, architecture string, abi string, pointer_size int"
    imports = spark.createDataFrame([("s", 1, "Core.dll", "Run", "stdcall", False, "ansi", "win-x86", "x86", "msvc", 4, [(0, "a", "int", "in", 0, 4, True, None, None)])], f"scope string, import_id long, library string, entry_point string, convention string, exact_spelling boolean, charset string, {target}, params {none}")
    row = {"export_name": "_Run@4", "library": "core", "binary_verified": True, "convention": "stdcall", "rid": "WIN-x86", "pointer_size": 4, "params": [(0, "a", "int", "in", 0, 4, True, None, None)], "exception_escape": None, "return_allocation": None} | export
    shape = f"scope string, export_id long, export_name string, library string, binary_verified boolean, convention string, {target}, params {none}, exception_escape string, return_allocation string"
    make = lambda i, r: ("s", i, r["export_name"], r["library"], r["binary_verified"], r["convention"], r["rid"], "x86", "msvc", r["pointer_size"], r["params"], r["exception_escape"], r["return_allocation"])
    return imports, lambda *more: spark.createDataFrame([make(k + 10, row | m) for k, m in enumerate(({}, *more))], shape)


@pytest.mark.parametrize("export, outcome", [
    ({}, "matched"), ({"binary_verified": False}, "source-matched"), ({"library": "other"}, "unmatched"), ({"library": None}, "unknown"),
    ({"export_name": "RunA"}, "matched"), ({"export_name": "RunW"}, "unmatched"), ({"pointer_size": 8}, "unknown"),
])
def test_import_matching(spark, export, outcome):
    imports, exports = facts(spark, **export)
    assert interop.match_imports(imports, exports()).first().outcome == outcome


def test_import_matching_of_several(spark):
    imports, exports = facts(spark)
    assert interop.match_imports(imports, exports({})).first().outcome == "ambiguous"
    first = interop.match_imports(imports, exports({"export_name": "RunA"})).first()
    assert (first.outcome, first.spelling, first.export_id) == ("matched", "_Run@4", 10)
    assert interop.match_imports(imports, exports().limit(0), complete=False).first().outcome == "unknown"
    assert interop.match_edges(imports, interop.match_imports(imports, exports())).first().dst == 10


def test_boundary_rules(spark):
    imports, exports = facts(spark, convention="cdecl", exception_escape="std::bad_alloc", return_allocation="malloc", params=[(0, "a", "int", "out", 1, 8, False, None, None)])
    retained = spark.createDataFrame([("s", 10, 0)], "scope string, export_id long, position int")
    usages = spark.createDataFrame([("s", 1, 0, False)], "scope string, import_id long, position int, rooted boolean")
    releases = spark.createDataFrame([("s", 1, "CoTaskMem")], "scope string, import_id long, release_family string")
    rows = interop.boundary_findings(imports, exports(), retained, usages, releases).collect()
    assert {r.rule for r in rows} == {"Interop001", "Interop003", "Interop004", "Interop005", "Interop006"}
    assert {r.detail.split(": ")[1] for r in rows if r.rule == "Interop003"} == {"direction", "pointer_depth", "size", "signed"}


def test_struct_layouts(spark):
    field = "array<struct<order:int,name:string,category:string,offset:int,size:int,pointer_depth:int,array_length:int>>"
    shape = f"scope string, record_id long, pair_id long, kind string, size int, align int, pack int, fields {field}"
    a = [("s", 1, 1, "struct", 8, 4, 8, [(0, "x", "int", 0, 4, 0, None)]), ("s", 2, 2, "struct", 8, 4, None, [(0, "x", "int", 0, 4, 0, None)])]
    b = [("s", 11, 1, "struct", 8, 4, 8, [(0, "x", "int", 0, 4, 0, None), (1, "y", "int", 4, 4, 0, None)]), ("s", 12, 2, "struct", 8, 4, 8, [(0, "x", "int", 0, 4, 0, None)])]
    checks = interop.compare_structs(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape))
    assert {r.managed_id: r.verdict for r in interop.struct_verdict(checks).collect()} == {1: "incompatible", 2: "unknown"}


def test_contract_rules(spark):
    shape = "scope string, rpc_key long, service string, method string, client_streaming boolean, server_streaming boolean"
    now = spark.createDataFrame([("s", 1, "Api", "Run", False, True), ("s", 2, "Api", "Stop", False, False), ("s", 3, "Api", "Twice", False, False), ("s", 4, "Api", "Twice", False, False)], shape)
    old = spark.createDataFrame([("s", 1, "Api", "Run", False, False)], shape)
    made = spark.createDataFrame([("s", 7, "Api", "Run", "server", True), ("s", 8, "Api", "Twice", "client", False), ("s", 9, "Api", "Run", "client", False)], "scope string, symbol_id long, service string, method string, role string, overrides_base boolean")
    fields = "scope string, full_name string, number int"
    found = rpc.check_contracts(now, made, spark.createDataFrame([("s", "M.x", 2)], fields), old, spark.createDataFrame([("s", "M.x", 1)], fields)).collect()
    assert {(r.key, r.rule) for r in found} == {("2", "Grpc001"), ("3", "Grpc001"), ("4", "Grpc001"), ("M.x", "Grpc002"), ("1", "Grpc003")}
    assert {tuple(r)[1:] for r in rpc.link(now, made).collect()} == {(9, 1, "grpc-calls"), (7, 1, "implements-rpc"), (1, 7, "rpc-dispatches-to")}


def test_hooks_and_tables(spark, tmp_path):
    t, ids = seed(spark, CALLS)
    hooks = admin.Registry()
    hooks.add_tool("count", lambda t: aggregate.row_counts(t, ("edges",)))
    assert hooks.call("count", t).first().n_rows == 5
    hooks.analyzers["bad"] = lambda t: 1 / 0
    hooks.analyzers["late"] = lambda t: t.with_tables(edges=t.edges.withColumn("payload", F.raise_error(F.lit("lazy")).cast("string")))
    same, failed = hooks.analyze(t)
    assert same is t and set(failed) == {"bad", "late"}  # a lazy frame fails inside the guard
    hooks.analyzers = {"few": lambda t: t.with_tables(edges=t.edges.limit(1))}
    assert hooks.analyze(t)[0].edges.count() == 1
    hooks.add_indexer("cs", (".cs",), lambda files: files.select("path"))
    with pytest.raises(ValueError):
        hooks.add_indexer("other", (".cs", ".x"), lambda files: files)
    assert hooks.index(t.files)["cs"].count() == 2
    hooks.node_kinds["ts"] = {"class_declaration": "class", "method_definition": "method"}
    nodes = spark.createDataFrame([("ts", "class_declaration", "A"), ("ts", "comment", "x"), ("go", "class_declaration", "y")], "language string, node_kind string, name string")
    assert [(r.name, r.kind_name) for r in hooks.map_kinds(nodes).collect()] == [("A", "class")]
    wanted = spark.createDataFrame([("s", "./a"), ("s", "b"), ("s", "c")], "scope string, specifier string")
    hooks.resolvers = [lambda w: w.withColumn("path", F.when(F.col("specifier").startswith("./"), "/a.ts")), lambda w: w.withColumn("path", F.when(F.col("specifier") != "c", "/lib.ts"))]
    assert {(r.specifier, r.path) for r in hooks.resolve_modules(wanted).collect()} == {("./a", "/a.ts"), ("b", "/lib.ts"), ("c", None)}
    admin.append_usage(spark, str(tmp_path / "log"), [("a", 1.0, True, 10, None), ("a", 3.0, False, 20, None)])
    assert aggregate.usage_stats(admin.read_usage(spark, str(tmp_path / "log"))).first().n_errors == 1
    assert admin.markdown_table(t.edges.select("src").orderBy("src"), 2).count("\n") == 5
    assert aggregate.budget_rows(500) == 96 and aggregate.budget_rows(1500) == 32
    register_views(spark, t, "x_")
    assert spark.table("x_v_files").count() == 2


def test_native_snapshot_is_refused_or_published_whole(spark):
    t, ids = seed(spark, CALLS)
    facts_of = spark.createDataFrame([("s", "csharp:M:A", "csharp:M:C", "pinvoke-maps-to", 1, "/a.cs", 7, 1, 7, 9, 2, "x")], "scope string, src_key string, dst_key string, kind_name string, producing_file_id long, file_path string, start_line int, start_col int, end_line int, end_col int, confidence int, payload string")
    scopes = spark.createDataFrame([("s",)], "scope string")
    mark = lambda flavor, symbol: spark.createDataFrame([("s", 5, symbol, "n", "n", flavor, "{}", None)], SCHEMAS["annotations"])
    new = merge.replace_native_snapshot(t, "native", scopes, ["interop-match"], facts_of, mark("interop-match", ids["A"]))
    again = merge.replace_native_snapshot(new, "native", scopes, ["interop-match"], facts_of, mark("interop-match", ids["A"]))
    assert new.annotations.count() == again.annotations.count() == 1 and again.edges.count() == len(CALLS) + 1
    for bad in (mark("other", ids["A"]), mark("interop-match", 99)):
        with pytest.raises(merge.UnresolvedEndpoint):
            merge.replace_native_snapshot(t, "native", scopes, ["interop-match"], facts_of, bad)


def scoped(spark):
    """Two scopes that share ids and names, and a shared symbol whose id the second has itself."""
    row = lambda scope, i, name: (scope, i, f"csharp:M:{scope}.{name}", name, f"{scope}.{name}", "method", 1, i, 1, i + 5, 1, f"void {name}()", None, None, 6, f"Documents {name}.", None)
    symbols = [row("a", 1, "Target"), row("a", 2, "Caller"), row("a", 4, "User"), row("b", 1, "Other"), row("b", 2, "CallerOfOther"), row("b", 3, "Third"), row("b", 7, "Seven"), ("shared", 7, "csharp:M:Lib", "Lib", "Lib.Lib", "method", None, None, None, None, None, None, None, None, 6, None, None)]
    edges = [("a", 2, 1), ("b", 2, 1), ("b", 3, 1), ("b", 3, 2), ("a", 4, 7), ("b", 3, 7)]
    proof = [(s, n, x, y, "calls", 1, f"/{s}.cs", n, 1, n, 9, 2, "compiler", "") for n, (s, x, y) in enumerate(edges)]
    refs = [("a", 1, 1, 1, 1, 1, 2), ("b", 1, 1, 1, 1, 1, 2), ("b", 2, 7, 1, 1, 1, 2), ("a", 2, 7, 1, 1, 1, 2)]
    make = lambda rows, table: spark.createDataFrame(rows, SCHEMAS[table])
    return empty_tables(
        spark, files=make([(s, 1, f"/{s}.cs", b"1", 1, 0) for s in "ab"], "files"), symbols=make(symbols, "symbols"), edges=make([(s, x, y, "calls", None) for s, x, y in edges], "edges"), edge_evidence=make(proof, "edge_evidence"), refs=make(refs, "refs"),
        scopes=make([("a", "A", "/a", 0, 1, "ready", None), ("b", "B", "/b", 0, 1, "ready", None), ("v", "V", "/v", 1, 1, "ready", None)], "scopes"),
    )


def test_scopes_stay_apart(spark):
    t = scoped(spark)
    node = lambda scope, i: spark.createDataFrame([(scope, i)], "scope string, id long")
    of = lambda rows, *columns: sorted(tuple(r[c] for c in columns) for r in rows.collect())
    assert of(lookup.find_references(t, node("a", 1)), "scope", "id") == [("a", 1)]
    assert of(lookup.find_references(t, node("shared", 7)), "scope", "id") == [("a", 2)]  # b means its own seven
    assert of(traversal.adjacent(t, node("a", 1)), "scope", "src") == [("a", 2)]
    assert of(traversal.adjacent(t, node("b", 1)), "scope", "src") == [("b", 2), ("b", 3)]
    assert of(traversal.adjacent(t, node("shared", 7)), "scope", "src") == [("a", 4)]
    assert of(traversal.adjacent(t, node("b", 3), inbound=False), "scope", "dst") == [("b", 1), ("b", 2), ("b", 7)]
    assert of(traversal.list_calls(t, node("a", 1)), "scope", "src", "truncated_evidence") == [("a", 2, False)]
    assert of(traversal.impact_of_change(t, node("a", 1)), "scope", "id") == [("a", 2)]
    assert of(traversal.impact_levels(t, node("shared", 7)), "scope", "id", "depth") == [("a", 4, 1)]
    assert of(aggregate.in_degrees(t), "scope", "dst", "in_degree") == [("a", 1, 1), ("b", 1, 2), ("b", 2, 1), ("b", 7, 1), ("shared", 7, 1)]
    assert of(aggregate.module_summary(t, "a"), "id", "in_degree") == [(1, 1), (2, 0), (4, 0)]
    card = lookup.symbol_card(t, "csharp:M:a.Target").first()
    assert (card.n_callers, card.n_references) == (1, 1)
    assert of(lookup.list_tests_for(t, node("a", 1), True), "id") == []
    assert of(payload.two_sided(t, t.edges), "src_fqn", "dst_fqn") == [("a.Caller", "a.Target"), ("a.User", "Lib.Lib"), ("b.CallerOfOther", "b.Other"), ("b.Third", "b.CallerOfOther"), ("b.Third", "b.Other"), ("b.Third", "b.Seven")]
    assert of(traversal.ancestors_by_relation(t, "calls"), "scope", "id", "base_scope", "base", "depth") == [("a", 2, "a", 1, 1), ("a", 4, "shared", 7, 1), ("b", 2, "b", 1, 1), ("b", 3, "b", 1, 1), ("b", 3, "b", 2, 1), ("b", 3, "b", 7, 1)]
    paths = trace.trace_paths(t, node("b", 3), node("b", 1), trace.relation("calls"))
    assert sorted(r.path_ids for r in paths.paths.collect()) == [[3, 1], [3, 2, 1]] and paths.absence_authoritative
    assert trace.trace_paths(t, node("a", 4), node("b", 7), trace.relation("calls")).paths.count() == 0
    assert of(trace.paths_into(t, t.symbols, node("shared", 7)), "path_ids", "path_scopes") == [([4, 7], ["a", "shared"])]
    gone = merge.delete_symbols(t, node("shared", 7))
    assert of(gone.edges, "scope", "src", "dst") == sorted((s, x, y) for s, x, y in (("a", 2, 1), ("b", 2, 1), ("b", 3, 1), ("b", 3, 2), ("b", 3, 7)))
    bad = {r["check"]: r.n_rows for r in merge.integrity(t).collect()}
    assert not any(bad.values())


def test_tools_route_scopes(spark):
    t = scoped(spark)
    assert [r.fqn for r in tools.call("find_callers", t, scope="a", symbol="Target").collect()] == ["a.Caller"]
    assert {r.scope for r in tools.call("search_symbols", t, scope="*", query="caller").collect()} == {"a", "b"}
    assert tools.call("find_definition", t, scope="b", symbol="a.Target").count() == 0
    for scope in (None, "zzz", "a,*"):
        with pytest.raises(adhoc.QueryError):
            tools.call("list_callers", t, scope=scope, symbol="Target")
    with pytest.raises(ValueError):
        tools.call("list_callers", t, scope="a", symbol="Target", kind="nonsense")
    assert tools.call("list_callers", t, scope="a", symbol="Target", kind="Pinvoke_Maps_To").count() == 0
    assert tools.call("query_graph", t, sql="SELECT count(*) AS n FROM v_symbols WHERE scope = @s", parameters={"s": "a"}).first().n == 3
    assert tools.call("describe_schema", t, scope="a").filter("part = 'edge_kinds'").first().name == "calls"
    assert tools.call("ping", t).first().answer == "pong" and len(tools.TOOLS) + len(tools.ALIASES) == 49
    few = tools.answer("list_symbols_in_file", t, scope="b", path="/b.cs", budget=3000)
    assert len(few.rows) == 2 and few.omitted == 2 and few.truncated and few.scopes == ["b"]
    one = tools.answer("list_callers", t, scope="b", symbol="b.Other", limit=1)
    assert len(one.rows) == 1 and one.truncated and not tools.answer("list_callers", t, scope="b", symbol="b.Other", limit=2).truncated
    deep = tools.answer("trace_call_path", t, scope="b", source="b.Third", target="b.Other", max_depth=1)
    assert [r[0] for r in deep.rows] == [[3, 1]] and deep.truncated
    assert tools.answer("impact_of_change", t, scope="b", symbol="b.Other", max_depth=1).truncated is False
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0], b"1", "m"), ("b", 1, [0.0, 1.0], b"1", "m"), ("b", 99, [0.0, 0.0], b"1", "m")], SCHEMAS["embeddings"])
    with_vectors = t.with_tables(embeddings=vectors)
    found = tools.call("semantic_search", with_vectors, scope="*", query="x", embed=lambda text: [0.0, 1.0], k=1).collect()
    assert [(r.scope, r.symbol_id) for r in found] == [("b", 1)]
    check = tools.call("embeddings_verify", with_vectors).first()
    assert (check.n_vectors, check.n_damaged, check.n_stale) == (3, 1, 1)
    assert tools.call("embeddings_remove", with_vectors, model="m").count() == 0 and tools.call("embeddings_status", with_vectors).first().n_vectors == 3
    assert tools.call("match_pinvoke", t, scope="a", symbol="a.Target").first().state == "not-analyzed"
    assert {r.status for r in tools.call("compare_struct", t, scope="*", managed="a.Target", native="b.Other").collect()} == {"unknown"}


def test_cut_walks_claim_nothing(spark):
    chain = [(f"N{k}", f"N{k + 1}", k, 2, "calls") for k in range(6)]
    t, ids = seed(spark, chain)
    ends = at(spark, ids["N0"]), at(spark, ids["N6"]), trace.relation("calls")
    short = trace.trace_paths(t, *ends, max_depth=3)
    assert short.paths.count() == 0 and short.truncated and not short.absence_authoritative
    whole = trace.trace_paths(t, *ends, max_depth=6)
    assert whole.paths.count() == 1 and whole.absence_authoritative
    assert trace.trace_paths(t, at(spark, ids["N6"]), at(spark, ids["N0"]), trace.relation("calls"), max_depth=1).absence_authoritative
    assert not trace.trace_paths(t, *ends, complete=False).absence_authoritative
    ran = spark.createDataFrame([("s", "grpc", "complete", False, 0), ("s", "native-interop", "complete", True, 0)], "scope string, name string, status string, retained_last_good boolean, failures long")
    states = lambda *more: {(r.name, r.authoritative) for r in trace.projection_states(t, ["s"], *more).collect()}
    assert states() == {("scope", True)} and states(None, True) == {("scope", True), ("grpc", False), ("native-interop", False)}
    assert states(ran, True) == {("scope", True), ("grpc", True), ("native-interop", False)}
    assert trace.is_complete(trace.projection_states(t, ["s"])) and not trace.is_complete(trace.projection_states(t, ["nobody"]))
    assert traversal.impact(t, at(spark, ids["N6"]), max_depth=3).truncated and not traversal.impact(t, at(spark, ids["N6"]), max_depth=6).truncated
    star, ids = seed(spark, [(f"S{k}", "Hub", k, 2, "calls") for k in range(8)])
    few, exact = (traversal.impact(star, at(spark, ids["Hub"]), limit=n) for n in (5, 8))
    assert few.truncated and few.rows.count() == 5 and exact.rows.count() == 8 and not exact.truncated
    assert [r.id for r in few.rows.orderBy("id").collect()] == [r.id for r in exact.rows.orderBy("id").limit(5).collect()]


def test_resources_and_elements(spark):
    edges = [("A", "B", 1, 2, "uses-resource"), ("A", "C", 1, 2, "uses-resource"), ("D", "B", 1, 2, "applies-style")]
    t, ids = seed(spark, edges, payloads={("A", "B"): '{"key":"Brush"}', ("A", "C"): '{"key":"Brush"}', ("D", "B"): '{"key":"Font"}'})
    gone = t.with_tables(edges=t.edges.unionByName(spark.createDataFrame([("s", ids["D"], 99, "uses-resource", '{"key":"Lost"}')], SCHEMAS["edges"])))
    assert {(r.key, r.n_definitions, r.status) for r in ui.check_resources(gone).collect()} == {("Brush", 2, "ambiguous"), ("Font", 1, "matched"), ("Lost", 0, "missing")}
    twice = t.with_tables(symbols=t.symbols.withColumn("fqn", F.when(F.col("id") == ids["B"], "X.A").otherwise(F.col("fqn"))))
    assert {r.status for r in ui.trace_binding(twice, element="A").collect()} == {"ambiguous"}


def test_one_line_renderings(spark):
    rows = [(1, "/a.cs", 3, 9, 6, "static,async", "First. Second.", '{"path":"a\\"b","n":69,"x":null}'), (2, "/b.cs", None, 1, 0, None, "  \r\n", "[1]"), (3, "/c.cs", 1, 1, 5, "", "word " * 60, '{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}'), (4, "/d.cs", 1, 1, None, None, None, '{"a":')]
    t = spark.createDataFrame(rows, "id int, path string, start_line int, start_col int, accessibility int, modifiers string, xml_summary string, payload string").withColumn("kind_name", F.lit("method"))
    out = t.select("id", fmt.location().alias("at"), fmt.kind_with_attributes(generated=F.col("id") == 3).alias("kind"), fmt.one_line_summary().alias("text"), fmt.payload_line().alias("p")).orderBy("id").collect()
    assert [r["at"] for r in out] == ["/a.cs:3:9", None, "/c.cs:1:1", "/d.cs:1:1"]
    assert [r.kind for r in out] == ["public static async method", "method", "protected internal method (generated)", "method"]
    assert out[0].text == "First." and out[1].text is None and out[2].text == ("word " * 24).strip() + "…" and out[3].text is None
    assert [r.p for r in out] == ['{ path: "a\\"b", n: 69, x: null }', None, "{ a: 1, b: 2, c: 3, d: 4, e: 5 (1 more) }", None]
    history = spark.createDataFrame([("abcdef0123", "ana", 86_400_000), (None, None, 5), ("", "bo", None)], "last_commit_sha string, last_author string, last_authored_at long")
    assert {r[0] for r in history.select(fmt.history_line()).collect()} == {"last touched 1970-01-02 by ana (abcdef0)", None, "last touched ? by bo ((none))"}


def test_generated_code_is_proven(spark):
    contracts = spark.createDataFrame([("s", 1, "Api", "Run", "Ask", "Answer", False, True), ("s", 2, "Api", "Stop", "Ask", "Answer", False, False), ("s", 3, "Api", "Two", "Ask", "Answer", False, False), ("s", 4, "Api", "Two", "Ask", "Answer", False, False)], "scope string, rpc_key long, service string, method string, input string, output string, client_streaming boolean, server_streaming boolean")
    made = [("s", 11, "Api", "Run", "client", True, "Ask", "Answer", "server-streaming"), ("s", 12, "Api", "Run", "server", True, "Ask", "Answer", "server-streaming"), ("s", 13, "Api", "Stop", "client", False, "Ask", "Answer", "unary"), ("s", 14, "Api", "Stop", "server", True, "Ask", "Other", "unary"), ("s", 15, "Api", "Two", "client", True, "Ask", "Answer", "unary"), ("s", 16, "Api", "None", "client", True, "Ask", "Answer", "unary"), ("s", 17, "Api", "Stop", "client", True, None, "Answer", "unary")]
    generated = spark.createDataFrame(made, "scope string, symbol_id long, service string, method string, role string, contained boolean, request string, response string, shape string")
    proven, failures = rpc.prove(contracts, generated)
    assert {tuple(r)[1:] for r in proven.collect()} == {(11, "client", 1), (12, "server", 1)}
    assert {tuple(r)[1:] for r in failures.collect()} == {(13, 2, "evidence-missing"), (14, 2, "signature-mismatch"), (15, None, "ambiguous"), (17, 2, "signature-mismatch")}
    edges = spark.createDataFrame([("s", 21, 11, "calls", None), ("s", 22, 12, "overrides-member", None), ("s", 23, 11, "calls", None), ("s", 24, 12, "calls", None)], SCHEMAS["edges"])
    proof = spark.createDataFrame([("s", k, a, b, kind, 1, "/a.cs", 1, 1, 1, 2, 2, "compiler", "") for k, (a, b, kind) in enumerate(((21, 11, "calls"), (22, 12, "overrides-member"), (24, 12, "calls")))], SCHEMAS["edge_evidence"])
    assert {tuple(r)[1:] for r in rpc.proven_edges(proven, edges, proof).collect()} == {(21, 1, "grpc-calls"), (22, 1, "implements-rpc"), (1, 22, "rpc-dispatches-to")}


def test_stored_contracts_are_checked(spark):
    t, ids = seed(spark, [("Rpc", "Impl", 1, 2, "rpc-dispatches-to"), ("Gen", "Rpc", 1, 2, "calls")])
    contract = '{"kind":"rpc","service":"Api","method":"Run","client_streaming":false,"server_streaming":false,"input":"Ask","output":"Answer"}'
    made = '{"service":"Api","method":"Run","role":"client","contained":true,"request":"Ask","response":"%s","shape":"unary"}'
    mark = lambda i, flavor, args: ("s", i, i, "n", "n", flavor, args, None)
    for reply, rules in (("Other", {"Grpc004"}), ("Answer", set())):
        marks = spark.createDataFrame([mark(ids["Rpc"], "proto-contract", contract), mark(ids["Gen"], rpc.GENERATED_FLAVOR, made % reply)], SCHEMAS["annotations"])
        assert {r.rule for r in rpc.check_stored_contracts(t.with_tables(annotations=marks)).collect()} == rules


def test_records_map_where_they_stand_alone(spark):
    matches = spark.createDataFrame([("s", 1, "matched", 11, "x"), ("s", 2, "source-matched", 12, "x"), ("s", 3, "unknown", None, None)], "scope string, import_id long, outcome string, export_id long, spelling string")
    managed = spark.createDataFrame([("s", 1, 0, 100), ("s", 1, 1, 101), ("s", 2, 0, 101), ("s", 3, 0, 102)], "scope string, import_id long, position int, record_id long")
    native = spark.createDataFrame([("s", 11, 0, 200), ("s", 11, 1, 201), ("s", 12, 0, 202), ("s", 12, 1, 203)], "scope string, export_id long, position int, record_id long")
    edges = interop.struct_edges(matches, managed, native)
    assert [(r.src, r.dst, r.kind_name) for r in edges.collect()] == [(100, 200, "struct-maps-to")]  # 101 has two
    shape = "scope string, managed_id long, native_id long, aspect string, ordinal int, status string"
    checks = spark.createDataFrame([("s", 100, 200, "size", None, "incompatible"), ("s", 101, 201, "size", None, "compatible"), ("s", 101, 202, "pack", None, "unknown")], shape)
    assert {(r.import_id, r.severity, r.detail) for r in interop.rule_structs(matches, managed, native, checks).collect()} == {(1, "error", "parameter 0: incompatible"), (2, "warning", "parameter 0: unknown")}
    _, both = interop.publish_boundary(spark.createDataFrame([], "scope string"), matches, spark.createDataFrame([], "scope string, import_id long, export_id long, rule string, severity string, detail string"), edges)
    assert sorted(r.kind_name for r in both.collect()) == ["pinvoke-maps-to", "pinvoke-maps-to", "struct-maps-to"]


def test_nested_records(spark):
    shape = "scope string, managed_id long, native_id long, aspect string, ordinal int, status string"
    pairs = {(1, 11): "compatible", (2, 12): "compatible", (3, 13): "incompatible", (4, 14): "compatible", (5, 15): "compatible", (6, 16): "compatible"}
    checks = spark.createDataFrame([("s", a, b, "size", None, status) for (a, b), status in pairs.items()], shape)
    side = lambda rows: spark.createDataFrame([("s", r, k, n) for r, k, n in rows], "scope string, record_id long, ordinal int, nested long")
    managed = side([(1, 0, 2), (2, 0, 3), (4, 0, 5), (5, 0, 4), (6, 0, 7), (6, 1, None)])
    native = side([(11, 0, 12), (12, 0, 13), (14, 0, 15), (15, 0, 14), (16, 0, 17), (16, 1, 12)])
    mapping = spark.createDataFrame([("s", 2, 12), ("s", 3, 99), ("s", 4, 14), ("s", 5, 15)], "scope string, managed_id long, native_id long")
    got = {(r.managed_id, r.aspect): r.status for r in interop.compare_nested(checks, managed, native, mapping).collect()}
    assert {k: v for k, v in got.items() if k[1] != "size"} == {
        (1, "nested identity"): "compatible", (1, "nested layout"): "incompatible", (2, "nested identity"): "incompatible", (2, "nested layout"): "incompatible",
        (4, "nested identity"): "compatible", (4, "nested layout"): "compatible", (5, "nested identity"): "compatible", (5, "nested layout"): "compatible", (4, "cycle"): "incompatible", (5, "cycle"): "incompatible",
        (6, "nested identity"): "unknown", (6, "nested layout"): "unknown",
    }
    verdicts = {r.managed_id: r.verdict for r in interop.struct_verdict(interop.compare_nested(checks, managed, native, mapping)).collect()}
    assert verdicts == {1: "incompatible", 2: "incompatible", 3: "incompatible", 4: "incompatible", 5: "incompatible", 6: "unknown"}
