"""The named tools of the engine: one entry per tool, with aliases, over a bundle of tables.

Every tool takes ``scope``: nothing (the default scope, or the only one), '*' (all that aren't
isolated), or a list of ids; shared symbols are seen from all.  ``call`` gives the rows as a frame,
``answer`` a bounded result that says whether it was cut.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import adhoc, admin
from codeloom.functions.keys import EDGE_KINDS, edge_kind
from codeloom.operators import aggregate, interop, lookup, merge, payload, rpc, search, trace, traversal, ui, vector
from codeloom.session import collect_bounded
from codeloom.sources.readers import mock_vector
from codeloom.tables import SHARED, GraphTables


def vocabulary(t: GraphTables) -> frozenset[str]:
    """Edge kinds in use and those that are known anyway; empty where no edge is stored."""
    stored = {r[0] for r in collect_bounded(t.edges.select("kind_name").distinct(), adhoc.MOST_NAMES)}
    return frozenset(stored | set(EDGE_KINDS)) if stored else frozenset()


def _kind(t: GraphTables, kind: str | None) -> str | None:
    return edge_kind(kind, vocabulary(t)) if kind is not None else None


def _at(t: GraphTables, symbol: str) -> DataFrame:
    return lookup.top_match(t, symbol)


def trace_of(t: GraphTables, source: str, target: str | None = None, kind: str | None = None, profile: str | None = None, max_depth: int = 8, max_paths: int = 10, max_nodes: int = 1000, scopes: list[str] | None = None, projections: DataFrame | None = None) -> trace.Trace:
    """A trace; with ``scopes`` it is complete only if all that is known of them is authoritative."""
    if profile not in (None, "relation", "execution"):
        raise ValueError(f"unknown profile: {profile}")
    automaton = trace.EXECUTION if profile == "execution" else trace.relation(_kind(t, kind) or "calls")
    complete = scopes is None or trace.is_complete(trace.projection_states(t, scopes, projections, profile == "execution"))
    return trace.trace_paths(t, _at(t, source), None if target is None else _at(t, target), automaton, max_depth, max_paths, max_nodes, complete)


def _semantic(t: GraphTables, query: str, k: int = 20, kind: str | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """Nearest symbols to a text; ``embed`` gives its vector (by default the mock model's, of the
    dimension that the stored vectors have)."""
    if embed is None:
        one = t.embeddings.select(F.size("embedding").alias("d")).filter("d > 0").limit(1).first()
        embed = lambda text: mock_vector(text, one["d"] if one else 1)
    return vector.semantic_search(t, t.embeddings.select("scope", "symbol_id", "embedding"), embed(query), k, kind)


def _structs(t: GraphTables, managed: str, native: str) -> DataFrame:
    return interop.compare_stored(t, _at(t, managed), _at(t, native))


def _without_model(t: GraphTables, model: str | None = None, every: bool = False) -> DataFrame:
    if (model is None) == (not every):
        raise ValueError("name a model, or all")
    return t.embeddings.limit(0) if every else t.embeddings.filter(~F.col("model_version").eqNullSafe(F.lit(model)))


def _pull(t: GraphTables, vectors: DataFrame, model: str) -> DataFrame:
    """The stored vectors with those of a model (scope, symbol_id, embedding, content_hash) put in."""
    return merge.upsert_embeddings(t.embeddings, vectors.withColumn("model_version", F.lit(model)))


def _schema(t: GraphTables) -> DataFrame:
    """(part, name, detail): views, their columns, kinds in use, and the version of the views."""
    found = adhoc.describe_schema(t)
    rows = [("version", str(found["version"]), None)] + [("column", f"{v}.{c}", kind) for v, cs in found["views"].items() for c, kind in cs]
    rows += [(part, name, None) for part in ("edge_kinds", "symbol_kinds", "flavors") for name in found[part]]
    return t.files.sparkSession.createDataFrame(rows, "part string, name string, detail string")


def _sql(t: GraphTables, sql: str, parameters: dict | None = None, scope: str | None = "*") -> DataFrame:
    return adhoc.plan_query(t.files.sparkSession, t, sql, parameters, scope)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "find_definition": lambda t, symbol, file_hint=None, limit=25: lookup.find_definition(t, symbol, file_hint, limit),
    "find_by_annotation": lookup.find_by_annotation,
    "find_references": lambda t, symbol, limit=50, include_generated=False: lookup.find_references(t, _at(t, symbol), include_generated, limit),
    "list_symbols_in_file": lookup.list_symbols_in_file,
    "list_callers": lambda t, symbol, limit=50, kind="calls": traversal.list_calls(t, _at(t, symbol), _kind(t, kind), True, limit),
    "list_callees": lambda t, symbol, limit=50, kind="calls": traversal.list_calls(t, _at(t, symbol), _kind(t, kind), False, limit),
    "find_implementations": lambda t, symbol, include_abstract=False, limit=50: traversal.find_implementations(t, _at(t, symbol), "implements-member", include_abstract, limit),
    "find_data_bindings": payload.find_data_bindings,
    "find_event_handlers": payload.find_event_handlers,
    "search_symbols": search.search_symbols,
    "semantic_search": _semantic,
    "neighborhood": lambda t, symbol, per_category=20, kind=None: traversal.neighborhood(t, _at(t, symbol), _kind(t, kind), per_category),
    "module_summary": aggregate.module_summary,
    "impact_of_change": lambda t, symbol, max_depth=4, limit=100, kind="calls": traversal.impact_of_change(t, _at(t, symbol), _kind(t, kind), max_depth, limit),
    "list_members": lambda t, container, accessibility=None, limit=100: lookup.list_members(t, _at(t, container), accessibility, limit),
    "graph_stats": aggregate.row_counts,
    "find_diagnostics": lambda t, severity="warning", code=None, symbol=None, limit=100: lookup.find_diagnostics(t, severity, code, None if symbol is None else _at(t, symbol), limit),
    "list_generated_files": lookup.list_generated_files,
    "list_tests_for": lambda t, symbol, include_indirect=False, limit=50: lookup.list_tests_for(t, _at(t, symbol), include_indirect, limit),
    "who_authored": lambda t, symbol: lookup.who_authored(t, _at(t, symbol)),
    "recent_changes": lookup.recent_changes,
    "list_scopes": admin.list_scopes,
    "verify_scope": lambda t: admin.verify_scope(t)["integrity"],
    "trace_call_path": lambda t, source, target=None, kind=None, profile=None, max_depth=8, max_paths=10, max_nodes=1000: trace_of(t, source, target, kind, profile, max_depth, max_paths, max_nodes).paths,
    "trace_rpc": rpc.trace_rpc,
    "check_proto_contract": rpc.check_stored_contracts,
    "match_pinvoke": interop.stored_matches,
    "analyze_native_boundary": interop.stored_findings,
    "compare_struct": _structs,
    "trace_binding": ui.trace_binding,
    "trace_command": ui.trace_command,
    "check_resources": ui.check_resources,
    "describe_schema": _schema,
    "query_graph": _sql,
    "usage_stats": lambda t, path: aggregate.usage_stats(admin.read_usage(t.files.sparkSession, path)),
    "ping": lambda t: t.files.sparkSession.createDataFrame([("pong",)], "answer string"),
    "repair_scope": lambda t, store, mode="minimal": t.files.sparkSession.createDataFrame([(admin.repair_scope(store, mode, _single(t)),)], "version long"),
    "reconcile_drift": lambda t, seen, max_files=1000, complete=True: admin.reconcile_drift(t, seen, max_files, True, complete)[0],
    "embeddings_status": lambda t: t.embeddings.groupBy("model_version").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dimension")),
    "embeddings_verify": admin.verify_embeddings,
    "embeddings_pull": _pull,
    "embeddings_remove": _without_model,
}
#: Older names of the same tools.
ALIASES = {
    "search_code": "search_symbols", "find_symbol": "search_symbols", "find_reference": "find_references", "find_callers": "list_callers",
    "find_callees": "list_callees", "trace_call": "trace_call_path", "impact_analysis": "impact_of_change",
}
#: Tools that see all scopes unless told otherwise, and those that route scopes on their own.
WIDE = ("list_scopes", "verify_scope", "ping", "usage_stats", "embeddings_status", "embeddings_verify", "embeddings_pull", "embeddings_remove")
OWN_ROUTE = ("query_graph",)
#: Characters that a row of a tool's result takes, where it isn't 500 (fixed value of the output budget).
ROW_CHARS = {"list_callers": 1000, "list_callees": 1000, "impact_of_change": 1000, "trace_call_path": 1500, "trace_rpc": 1000}


def _single(t: GraphTables) -> str | None:
    ids = [r[0] for r in collect_bounded(t.scopes.select("id"), adhoc.MOST_SCOPES)]
    return ids[0] if len(ids) == 1 else None


def route(t: GraphTables, name: str, scope: str | None = None, default: str | None = None) -> tuple[GraphTables, list[str]]:
    """The tables of the scopes that a call asks for, and these scopes."""
    if name in WIDE and scope is None:
        return t, []
    scopes = adhoc.resolve_scopes(t, scope, default)
    return t.restrict([*scopes, SHARED]), scopes


def call(name: str, t: GraphTables, scope: str | None = None, default: str | None = None, **parameters) -> DataFrame:
    """The rows of a tool over the scopes asked for."""
    name = ALIASES.get(name, name)
    if name in OWN_ROUTE:
        return TOOLS[name](t, scope=scope or "*", **parameters)
    return TOOLS[name](route(t, name, scope, default)[0], **parameters)


@dataclass(frozen=True)
class Answer:
    """Rows of a tool.  ``truncated``: the limit, a cap or the output budget left something out;
    ``omitted`` counts the rows that the budget left out; ``absence_authoritative`` (of traces) says
    whether a path that isn't there is known not to exist."""

    columns: list[str]
    rows: list[tuple]
    truncated: bool
    omitted: int = 0
    scopes: list[str] = field(default_factory=list)
    absence_authoritative: bool | None = None


def answer(name: str, t: GraphTables, scope: str | None = None, default: str | None = None, budget: int = 50_000, **parameters) -> Answer:
    """Call a tool and collect its rows, which its limit bounds: one row more than the limit is asked
    for, which tells whether there are more; what doesn't fit the output budget is left out."""
    name = ALIASES.get(name, name)
    views, scopes = (t, [scope or "*"]) if name in OWN_ROUTE else route(t, name, scope, default)
    truncated, authoritative = False, None
    if name == "impact_of_change":
        done = traversal.impact(views, _at(views, parameters.pop("symbol")), _kind(views, parameters.pop("kind", "calls")), **parameters)
        frame, truncated, most = done.rows.orderBy("depth", "fqn", "scope", "id"), done.truncated, parameters.get("limit", 100)
    elif name == "trace_call_path":
        path = trace_of(views, **parameters, scopes=scopes)
        authoritative = path.absence_authoritative
        frame, truncated, most = path.paths, path.truncated, parameters.get("max_paths", 10)
    else:
        tool = TOOLS[name]
        limit = next((p for p in ("limit", "top_k", "k") if p in inspect.signature(tool).parameters), None)
        most = parameters.get(limit, inspect.signature(tool).parameters[limit].default) if limit else adhoc.ROW_CAP
        more = parameters | ({limit: most + 1} if limit and most is not None else {})
        frame = tool(views, **more, **({"scope": scope or "*"} if name in OWN_ROUTE else {}))
        most = adhoc.ROW_CAP if most is None else most
    rows = [tuple(r) for r in frame.limit(most + 1).collect()]
    truncated, rows = truncated or len(rows) > most, rows[:most]
    room = aggregate.budget_rows(ROW_CHARS.get(name, 500), budget)
    return Answer(frame.columns, rows[:room], truncated or len(rows) > room, max(0, len(rows) - room), scopes, authoritative)
