"""Queries of the code-graph operators over the projected model, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import aggregate as agg
from codeloom.operators import lookup, payload, search, trace, traversal
from codeloom.tables import PROJECTION_SQL, GraphTables, stored
from codeloom.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A fixed instant, so that results don't depend on the day they are asked on.
NOW_MS = 1_767_225_600_000

#: The most called symbol that has a file: the anchor that queries start from.
_ANCHOR = """
resolved AS (
  SELECT e.*, CASE WHEN e.dst IN (SELECT id FROM g_symbols WHERE scope = 'shared') AND NOT EXISTS (SELECT 1 FROM g_symbols s WHERE s.scope = e.scope AND s.id = e.dst) THEN 'shared' ELSE e.scope END AS dst_scope FROM g_edges e
), anchor AS (
  SELECT s.scope, s.id, s.canonical_key, s.fqn, s.name, s.file_id, s.container_id, f.path FROM (SELECT dst_scope, dst, count(*) AS n FROM resolved WHERE kind_name = 'calls' GROUP BY ALL) e
  JOIN g_symbols s ON s.scope = e.dst_scope AND s.id = e.dst JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id ORDER BY n DESC, s.id, s.scope LIMIT 1
), located AS (SELECT s.*, f.path FROM g_symbols s JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id),
audit AS (SELECT * FROM resolved e WHERE EXISTS (SELECT 1 FROM g_evidence v WHERE v.scope = e.scope AND v.src = e.src AND v.dst = e.dst AND v.kind_name = e.kind_name))"""


def anchor(t: GraphTables) -> DataFrame:
    called = traversal_counts(t)
    rows = lookup.located(t).join(called, ["scope", "id"])
    return rows.orderBy(F.desc("in_degree"), "id", "scope").limit(1)


def traversal_counts(t: GraphTables) -> DataFrame:
    return agg.in_degrees(t).withColumnRenamed("dst", "id")


def graph_sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{PROJECTION_SQL.strip()},{_ANCHOR}{',' + more if more else ''}\n{body}"


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    """Register a function of the model (and, if it takes one, the anchor row) as a query."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = stored(spark, sf_dir)
            if build.__code__.co_argcount == 1:
                return build(t)
            return build(t, t.once("anchor", lambda: anchor(t).first()))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = graph_sql(sql, more, recursive)
        return build

    return register


def node(t: GraphTables, row) -> DataFrame:
    """The anchor as a frame (scope, id)."""
    return t.files.sparkSession.createDataFrame([(row["scope"], row["id"])] if row else [], "scope string, id long")


# ---- curated views

_VIEW_SQL = {
    "v_symbols": "SELECT * EXCLUDE (kind_name), kind_name AS kind, CASE WHEN accessibility = 6 THEN 1 ELSE 0 END AS is_public, CASE WHEN kind_name IN ('class','struct','interface','enum','record','delegate') THEN 1 ELSE 0 END AS is_type FROM g_symbols",
    "v_files": "SELECT scope, id, path, lower(hex(content_sha256)) AS sha256, last_indexed_at, is_generated FROM g_files",
    "v_edges": "SELECT scope, src, dst, kind_name AS kind, payload FROM g_edges",
    "v_edge_evidence": "SELECT * EXCLUDE (kind_name, confidence, payload), kind_name AS kind, CASE confidence WHEN 0 THEN 'inferred' WHEN 1 THEN 'semantic' WHEN 2 THEN 'exact' ELSE confidence::VARCHAR END AS confidence, nullif(payload, '') AS payload FROM g_evidence",
    "v_references": "SELECT scope, id, symbol_id, file_id, line, col, CASE kind WHEN 0 THEN 'def' WHEN 1 THEN 'ref' WHEN 2 THEN 'call' WHEN 3 THEN 'impl' WHEN 4 THEN 'inherit' WHEN 5 THEN 'read' WHEN 6 THEN 'write' ELSE kind::VARCHAR END AS kind FROM g_refs",
    "v_scopes": "SELECT * FROM scopes",
    "v_annotations": "SELECT *, NULL::BIGINT AS attribute_symbol_id FROM g_annotations",
    "v_diagnostics": "SELECT * EXCLUDE (severity), CASE severity WHEN 0 THEN 'hidden' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' END AS severity FROM g_diagnostics",
    "v_history": "SELECT * FROM g_history",
}


def _view(name):
    def build(t):
        rows = VIEWS[name][0](t)
        return rows.withColumn("sha256", F.lower(F.hex("sha256"))) if name == "v_files" else rows

    return build


for _name, _sql in _VIEW_SQL.items():
    query(_name, _sql)(_view(_name))


# ---- lookups

_RANKED = """ranked AS (SELECT l.*, CASE WHEN l.canonical_key = q.text THEN 0 WHEN l.fqn = q.text THEN 1 WHEN l.name = q.text THEN 2 WHEN l.fqn ILIKE '%.' || q.text THEN 3 WHEN l.name ILIKE q.text || '%' THEN 4 WHEN l.fqn ILIKE '%' || q.text || '%' THEN 5 END AS rank FROM located l, wanted q),
top AS (SELECT * FROM ranked WHERE rank IS NOT NULL ORDER BY rank, length(fqn), fqn, scope, id LIMIT 25)"""
_NARROWED = "SELECT scope, id, canonical_key, name, fqn, kind_name, path, start_line, rank FROM top WHERE (SELECT min(rank) FROM top) > 1 OR rank = (SELECT min(rank) FROM top)"


@query("find_definition", _NARROWED, "wanted AS (SELECT name AS text FROM anchor)," + _RANKED)
def _(t, a):
    return lookup.find_definition(t, a["name"])


@query("find_definition_key", _NARROWED, "wanted AS (SELECT canonical_key AS text FROM anchor)," + _RANKED)
def _(t, a):
    return lookup.find_definition(t, a["canonical_key"])


@query("find_definition_fragment", _NARROWED, "wanted AS (SELECT 'journal' AS text)," + _RANKED)
def _(t):
    return lookup.find_definition(t, "journal")


@query("get_symbol", "SELECT s.scope, s.id, s.canonical_key, s.fqn, f.path FROM g_symbols s LEFT JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id WHERE s.canonical_key = (SELECT canonical_key FROM anchor)")
def _(t, a):
    return lookup.get_symbol(t, a["canonical_key"]).select("scope", "id", "canonical_key", "fqn", "path")


@query("list_symbols_in_file", "SELECT scope, path, id, name, fqn, kind_name, start_line, start_col FROM located WHERE path = (SELECT path FROM anchor) OR path ILIKE '%' || (SELECT path FROM anchor)")
def _(t, a):
    return lookup.list_symbols_in_file(t, a["path"])


@query("list_members", "SELECT scope, id, name, kind_name, accessibility, start_line, container_id FROM g_symbols WHERE (scope, container_id) IN (SELECT scope, container_id FROM anchor) AND accessibility = 6 ORDER BY start_line, name, id LIMIT 100")
def _(t, a):
    box = t.files.sparkSession.createDataFrame([(a["scope"], a["container_id"])], "scope string, id long")
    return lookup.list_members(t, box, "public")


@query("find_references", "SELECT r.scope, r.id, r.symbol_id, f.path, r.line, r.col, r.kind FROM g_refs r JOIN g_files f ON f.scope = r.scope AND f.id = r.file_id WHERE r.symbol_id = (SELECT id FROM anchor) AND r.scope = (SELECT scope FROM anchor) AND f.is_generated = 0 ORDER BY path, line, col, r.id, r.scope LIMIT 50")
def _(t, a):
    return lookup.find_references(t, node(t, a))


@query("find_diagnostics", "SELECT d.scope, d.id, d.symbol_id, s.fqn, d.severity, d.code, d.message, f.path, d.line, d.col FROM g_diagnostics d JOIN g_files f ON f.scope = d.scope AND f.id = d.file_id LEFT JOIN g_symbols s ON s.scope = d.scope AND s.id = d.symbol_id WHERE d.severity >= 2 AND d.code = 'CG0003' ORDER BY path, line, col, d.id LIMIT 100")
def _(t):
    return lookup.find_diagnostics(t, "warning", "CG0003")


@query("diagnostic_files", "SELECT DISTINCT scope, file_id FROM g_diagnostics WHERE code IN ('CG0001', 'CG0004')")
def _(t):
    return lookup.diagnostic_files(t, ["CG0001", "CG0004"])


_CLEANED = "translate(args_json, '{}[]\":,\\', '        ')"


@query("find_by_annotation", f"SELECT DISTINCT l.scope, l.id, l.fqn, l.kind_name, l.path, l.start_line FROM g_annotations a JOIN located l ON l.scope = a.scope AND l.id = a.symbol_id WHERE a.name = 'Static' AND contains(lower({_CLEANED}), 'method') AND l.kind_name = 'method' ORDER BY path, start_line, l.id LIMIT 50")
def _(t):
    return lookup.find_by_annotation(t, "Static", argument=" Method ", kind="method")


@query("annotations_page", "SELECT id, symbol_id, name FROM g_annotations WHERE flavor = 'csharp-attribute' AND id > 20000 ORDER BY id LIMIT 1000")
def _(t):
    return lookup.annotations_page(t, "csharp-attribute", 20_000).select("id", "symbol_id", "name")


@query("annotations_in_files", "SELECT a.scope, a.id, a.symbol_id, s.file_id FROM g_annotations a JOIN g_symbols s ON s.scope = a.scope AND s.id = a.symbol_id JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id WHERE f.is_generated = 1 AND a.flavor IN ('test', 'cpp-attribute')")
def _(t):
    files = t.files.filter("is_generated = 1").select("scope", F.col("id").alias("file_id"))
    return lookup.annotations_in_files(t, files, ["test", "cpp-attribute"]).select("scope", "id", "symbol_id", "file_id")


@query("list_generated_files", "SELECT f.scope, f.id AS file_id, f.path, count(s.id) AS n_symbols FROM g_files f LEFT JOIN g_symbols s ON s.scope = f.scope AND s.file_id = f.id WHERE f.is_generated = 1 GROUP BY ALL ORDER BY n_symbols DESC, path, file_id LIMIT 100")
def _(t):
    return lookup.list_generated_files(t)


@query("outgoing_state", "SELECT f.scope, f.id AS file_id, f.is_generated = 1 AS is_generated, EXISTS (SELECT 1 FROM g_refs r WHERE r.scope = f.scope AND r.file_id = f.id) OR EXISTS (SELECT 1 FROM g_symbols s JOIN g_edges e ON e.scope = s.scope AND e.src = s.id WHERE s.scope = f.scope AND s.file_id = f.id) AS has_outgoing FROM g_files f")
def _(t):
    return lookup.outgoing_state(t)


@query("list_tests_for", "SELECT l.scope, l.id, l.fqn, l.test_framework, false AS direct, l.path, l.start_line FROM located l WHERE EXISTS (SELECT 1 FROM g_edges e WHERE e.scope = l.scope AND e.src = l.id AND e.kind_name = 'calls' AND e.dst = (SELECT id FROM anchor) AND e.scope = (SELECT scope FROM anchor)) AND test_framework IS NOT NULL ORDER BY path, start_line, id LIMIT 50")
def _(t, a):
    return lookup.list_tests_for(t, node(t, a), indirect=True)


@query("who_authored", "SELECT h.* FROM g_history h JOIN g_symbols s ON s.scope = h.scope AND s.id = h.symbol_id WHERE s.file_id = (SELECT file_id FROM anchor) AND s.scope = (SELECT scope FROM anchor)")
def _(t, a):
    inside = t.symbols.filter((F.col("file_id") == a["file_id"]) & (F.col("scope") == a["scope"])).select("scope", "id")
    return lookup.who_authored(t, inside)


@query("recent_changes", f"SELECT h.scope, h.symbol_id, l.fqn, l.path, h.last_author, h.last_authored_at FROM g_history h JOIN located l ON l.scope = h.scope AND l.id = h.symbol_id WHERE last_authored_at >= {NOW_MS} - 90 * 86400000::BIGINT AND last_author ILIKE '%E%' ORDER BY last_authored_at DESC, fqn, symbol_id LIMIT 50")
def _(t):
    return lookup.recent_changes(t, NOW_MS, 90, "E")


@query("history_of", "SELECT s.scope, s.id AS symbol_id, h.last_author, h.last_authored_at FROM g_symbols s LEFT JOIN g_history h ON h.scope = s.scope AND h.symbol_id = s.id WHERE s.kind_name = 'class'")
def _(t):
    return lookup.history_of(t, t.symbols.filter("kind_name = 'class'").select("scope", F.col("id").alias("symbol_id")))


@query("edge_evidence_of", "SELECT scope, src, dst, kind_name, id, file_path, start_line, confidence, producer FROM g_evidence WHERE dst = (SELECT id FROM anchor) AND scope = (SELECT scope FROM anchor) QUALIFY row_number() OVER (PARTITION BY scope, src, dst, kind_name ORDER BY file_path, start_line, start_col, id) <= 20")
def _(t, a):
    rows = lookup.edge_evidence(t, t.edges.filter((F.col("dst") == a["id"]) & (F.col("scope") == a["scope"])), 20)
    return rows.select("scope", "src", "dst", "kind_name", "id", "file_path", "start_line", "confidence", "producer")


@query("symbol_card", "SELECT l.scope, l.id, l.canonical_key, l.fqn, l.kind_name, l.signature, l.path, l.start_line, (SELECT count(*) FROM g_edges e WHERE e.scope = l.scope AND e.dst = l.id AND kind_name = 'calls') AS n_callers, (SELECT count(*) FROM g_edges e WHERE e.scope = l.scope AND e.src = l.id AND kind_name = 'calls') AS n_callees, (SELECT count(*) FROM g_refs r WHERE r.scope = l.scope AND r.symbol_id = l.id) AS n_references, (SELECT count(*) FROM g_symbols m WHERE m.scope = l.scope AND m.container_id = l.id) AS n_members FROM located l WHERE l.canonical_key = (SELECT canonical_key FROM anchor)")
def _(t, a):
    return lookup.symbol_card(t, a["canonical_key"])


# ---- payloads

_VALID = "CASE WHEN json_valid(payload) THEN payload END"
_BIND = f"""bind AS (SELECT *, json_extract_string({_VALID}, '$.path') AS path, json_extract_string({_VALID}, '$.mode') AS mode, json_extract_string({_VALID}, '$.converter') AS converter FROM resolved WHERE kind_name = 'binds-path'),
named AS (SELECT s.scope, s.id, s.canonical_key, s.fqn, s.start_line, f.path FROM g_symbols s LEFT JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id)"""


@query("find_data_bindings", "SELECT b.scope, s.fqn AS src_fqn, d.fqn AS dst_fqn, b.path, b.mode, b.converter, s.path AS src_path, s.start_line AS src_line FROM bind b JOIN named s ON s.scope = b.scope AND s.id = b.src JOIN named d ON d.scope = b.dst_scope AND d.id = b.dst WHERE instr(b.path, 'Items') > 0 AND b.mode = 'TwoWay' ORDER BY s.path NULLS FIRST, s.start_line NULLS FIRST, s.fqn, d.fqn, b.src, b.dst LIMIT 50", _BIND)
def _(t):
    return payload.find_data_bindings(t, path="Items", mode="TwoWay")


@query("payload_keys", f"SELECT kind_name, payload_key, count(*) AS n FROM (SELECT kind_name, unnest(json_keys({_VALID})) AS payload_key FROM g_edges) GROUP BY ALL")
def _(t):
    return payload.payload_keys(t)


@query("two_sided_edges", "SELECT e.scope, e.kind_name, s.fqn AS src_fqn, d.fqn AS dst_fqn, s.path AS src_path, d.path AS dst_path FROM resolved e JOIN named s ON s.scope = e.scope AND s.id = e.src JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst WHERE e.kind_name = 'inherits'", _BIND)
def _(t):
    return payload.two_sided(t, t.edges.filter("kind_name = 'inherits'")).select("scope", "kind_name", "src_fqn", "dst_fqn", "src_path", "dst_path")


# ---- aggregates

@query("module_summary", "SELECT l.scope, l.id, l.fqn, l.kind_name, l.path, coalesce(n, 0) AS in_degree FROM located l LEFT JOIN (SELECT dst_scope, dst, count(*) AS n FROM resolved WHERE kind_name = 'calls' GROUP BY ALL) c ON c.dst_scope = l.scope AND c.dst = l.id WHERE l.fqn = p() OR l.fqn ILIKE p() || '.%' OR contains(l.path, p()) ORDER BY in_degree DESC, length(fqn), fqn, l.id, l.scope LIMIT 25".replace("p()", "(SELECT split_part(fqn, '.', 1) FROM anchor)"))
def _(t, a):
    return agg.module_summary(t, a["fqn"].split(".")[0])


@query("in_degrees", "SELECT dst_scope AS scope, dst, count(*) AS in_degree FROM resolved WHERE kind_name = 'calls' GROUP BY ALL")
def _(t):
    return agg.in_degrees(t)


@query("graph_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {v}" for n, v in (("files", "g_files"), ("symbols", "g_symbols"), ("refs", "g_refs"), ("edges", "g_edges"), ("edge_evidence", "g_evidence"), ("annotations", "g_annotations"), ("diagnostics", "g_diagnostics"), ("symbol_history", "g_history"))))
def _(t):
    return agg.row_counts(t, ("files", "symbols", "refs", "edges", "edge_evidence", "annotations", "diagnostics", "symbol_history"))


@query("vocabularies", "SELECT 'edge-kind' AS vocabulary, kind_name AS value, count(*) AS n FROM g_edges GROUP BY ALL UNION ALL SELECT 'symbol-kind', kind_name, count(*) FROM g_symbols GROUP BY ALL UNION ALL SELECT 'annotation-flavor', flavor, count(*) FROM g_annotations GROUP BY ALL")
def _(t):
    return agg.vocabularies(t)


@query("scope_vocabulary", "SELECT scope, kind_name AS value, count(*) AS n FROM g_edges GROUP BY ALL UNION ALL SELECT '*', kind_name, count(*) FROM g_edges GROUP BY ALL UNION ALL SELECT '*', 'tests', 0")
def _(t):
    return agg.scope_vocabulary(t, ("calls", "inherits", "tests"))


@query("hop_confidence", "SELECT scope, src, dst, kind_name, max(confidence) AS confidence, min(confidence) AS weakest, count(*) AS n_evidence FROM (SELECT * FROM g_evidence QUALIFY row_number() OVER (PARTITION BY scope, src, dst, kind_name ORDER BY file_path, start_line, start_col, id) <= 21) GROUP BY ALL")
def _(t):
    return agg.hop_confidence(t)


@query("first_evidence", "SELECT scope, src, dst, kind_name, nullif(arg_min(payload, id), '') AS payload, min(id) AS evidence_id FROM g_evidence GROUP BY scope, src, dst, kind_name")
def _(t):
    return agg.first_evidence(t)


_LINES = "lines AS (SELECT scope, file_id, line, md5(max(id)::VARCHAR) AS sha, 'a' || (max(id) % 7) AS author, max(id) AS authored_at FROM g_refs GROUP BY ALL), spans AS (SELECT s.scope, s.id AS symbol_id, s.file_id, s.start_line, least(s.end_line, m.last) AS end_line FROM g_symbols s JOIN (SELECT scope, file_id, max(line) AS last FROM lines GROUP BY ALL) m ON m.scope = s.scope AND m.file_id = s.file_id)"


@query("blame_spans", "SELECT s.scope, s.symbol_id, arg_max(l.sha, struct_pack(a := l.authored_at, b := -l.line)) AS last_commit_sha, arg_max(l.author, struct_pack(a := l.authored_at, b := -l.line)) AS last_author, max(l.authored_at) AS last_authored_at, s.end_line - s.start_line + 1 AS line_count FROM spans s JOIN lines l ON l.scope = s.scope AND l.file_id = s.file_id AND l.line BETWEEN s.start_line AND s.end_line WHERE s.start_line <= s.end_line GROUP BY s.scope, s.symbol_id, s.start_line, s.end_line", _LINES)
def _(t):
    lines = t.refs.groupBy("scope", "file_id", "line").agg(F.max("id").alias("authored_at"))
    lines = lines.select("scope", "file_id", "line", F.md5(F.col("authored_at").cast("string")).alias("sha"), F.concat(F.lit("a"), (F.col("authored_at") % 7).cast("string")).alias("author"), "authored_at")
    spans = t.symbols.select("scope", F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    return agg.blame_spans(spans, lines)


@query("fair_share", "SELECT scope, id, fqn FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY fqn, id) AS nth, dense_rank() OVER (ORDER BY scope) AS scope_no, (SELECT count(DISTINCT scope) FROM g_symbols) AS scopes FROM g_symbols) WHERE nth <= 100 // scopes + CASE WHEN scope_no <= 100 % scopes THEN 1 ELSE 0 END")
def _(t):
    n = t.symbols.select("scope").distinct().count()
    return agg.fair_share(t.symbols, ["fqn", "id"], 100, n).select("scope", "id", "fqn")


# ---- search

_SEARCH = """corpus AS (SELECT *, lower(coalesce(name, '')) AS c1, lower(coalesce(fqn, '')) AS c2, lower(coalesce(signature, '')) AS c3, lower(coalesce(xml_summary, '')) AS c4 FROM g_symbols),
docs AS (SELECT *, greatest(length(c1) - 2, 0) + greatest(length(c2) - 2, 0) + greatest(length(c3) - 2, 0) + greatest(length(c4) - 2, 0) AS tokens,
  (length(c1) - length(replace(c1, 'journal', ''))) // 7 + (length(c2) - length(replace(c2, 'journal', ''))) // 7 + (length(c3) - length(replace(c3, 'journal', ''))) // 7 + (length(c4) - length(replace(c4, 'journal', ''))) // 7 AS f FROM corpus),
stats AS (SELECT count(*) AS n, avg(tokens) AS mean, count(*) FILTER (WHERE f > 0) AS hit FROM docs)"""


@query("search_symbols", "SELECT scope, id, name, fqn, kind_name, round(-greatest(ln((n - hit + 0.5) / (hit + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tokens / mean)), 6) AS score FROM docs, stats WHERE f > 0 AND kind_name = 'method' ORDER BY score, scope, id LIMIT 25", _SEARCH)
def _(t):
    return search.search_symbols(t, "Journal", "method")


@query("search_annotations", f"SELECT scope, id, args_json FROM g_annotations WHERE contains(lower({_CLEANED}), 'xunit')")
def _(t):
    return search.search_annotations(t, "xUnit").select("scope", "id", "args_json")


@query("embedding_text", "SELECT scope, symbol_id, sha256(text) AS content_hash FROM (SELECT s.scope, s.id AS symbol_id, concat_ws(chr(10), s.kind_name || ' ' || s.fqn, CASE WHEN trim(s.xml_summary, ' ') <> '' THEN s.xml_summary END, CASE WHEN trim(s.signature, ' ') <> '' THEN s.signature END) AS text FROM g_symbols s JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id WHERE f.is_generated = 0 AND trim(coalesce(s.xml_summary, ''), ' ') <> '')")
def _(t):
    return search.embedding_text(t).select("scope", "symbol_id", "content_hash")


# ---- traversal

_ADJ = "SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name AS symbol_kind, l.path, l.start_line FROM {edges} e JOIN located l ON l.scope = e.scope AND l.id = e.{far} WHERE e.{near} = (SELECT id FROM anchor) AND e.scope = (SELECT scope FROM anchor) AND e.kind_name = 'calls' ORDER BY e.kind_name, path, start_line, e.src, e.dst, e.scope LIMIT {n}"


@query("list_callers", _ADJ.format(edges="g_edges", far="src", near="dst", n=50))
def _(t, a):
    return traversal.adjacent(t, node(t, a), "calls")


@query("list_callees", _ADJ.format(edges="g_edges", far="dst", near="src", n=50))
def _(t, a):
    return traversal.adjacent(t, node(t, a), "calls", inbound=False)


@query("auditable_callers", _ADJ.format(edges="audit", far="src", near="dst", n=1000))
def _(t, a):
    return traversal.adjacent(t, node(t, a), "calls", evidence=True, limit=1000)


@query("callers_with_evidence", "SELECT c.*, (SELECT max(confidence) FROM g_evidence v WHERE v.scope = c.scope AND v.src = c.src AND v.dst = c.dst AND v.kind_name = c.kind_name) AS confidence, (SELECT least(count(*), 20) FROM g_evidence v WHERE v.scope = c.scope AND v.src = c.src AND v.dst = c.dst AND v.kind_name = c.kind_name) AS n_evidence, (SELECT count(*) FROM g_evidence v WHERE v.scope = c.scope AND v.src = c.src AND v.dst = c.dst AND v.kind_name = c.kind_name) > 20 AS truncated_evidence FROM (" + _ADJ.format(edges="audit", far="src", near="dst", n=50) + ") c")
def _(t, a):
    return traversal.list_calls(t, node(t, a)).withColumn("n_evidence", F.size("evidence").cast("long")).drop("evidence")


@query("find_implementations", "SELECT * FROM (SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name AS symbol_kind, l.path, l.start_line, l.signature FROM resolved e JOIN located l ON l.scope = e.scope AND l.id = e.src WHERE (e.dst_scope, e.dst) IN (SELECT (dst_scope, dst) FROM resolved WHERE kind_name = 'inherits' GROUP BY dst_scope, dst ORDER BY count(*) DESC, dst, dst_scope LIMIT 1) AND e.kind_name = 'inherits' ORDER BY e.kind_name, path, start_line, e.src, e.dst, e.scope LIMIT 50) WHERE NOT contains(coalesce(signature, ''), 'abstract')")
def _(t):
    base = agg.in_degrees(t, "inherits").orderBy(F.desc("in_degree"), "dst", "scope").limit(1).select("scope", F.col("dst").alias("id"))
    rows = traversal.find_implementations(t, base, "inherits")
    return rows.join(t.symbols.select("scope", F.col("id").alias("src"), "signature"), ["scope", "src"], "left")


@query("neighborhood", " UNION ALL ".join("SELECT *, '" + d + "' AS direction FROM (SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name AS symbol_kind, l.path, l.start_line FROM g_edges e JOIN located l ON l.scope = e.scope AND l.id = e." + far + " WHERE e." + near + " = (SELECT id FROM anchor) AND e.scope = (SELECT scope FROM anchor) ORDER BY e.kind_name, path, start_line, e.src, e.dst, e.scope LIMIT 20)" for d, far, near in (("in", "src", "dst"), ("out", "dst", "src"))))
def _(t, a):
    return traversal.neighborhood(t, node(t, a))


_LEVELS = """up(scope, id, depth) AS (SELECT DISTINCT scope, src, 1 FROM {edges} WHERE kind_name = 'calls' AND dst = (SELECT id FROM anchor) AND dst_scope = (SELECT scope FROM anchor) UNION SELECT e.scope, e.src, u.depth + 1 FROM {edges} e JOIN up u ON e.dst_scope = u.scope AND e.dst = u.id WHERE e.kind_name = 'calls' AND u.depth < 4)"""


@query("impact_levels", "SELECT scope, id, min(depth) AS depth FROM up GROUP BY scope, id", _LEVELS.format(edges="resolved"), recursive=True)
def _(t, a):
    return traversal.impact_levels(t, node(t, a), "calls", 4)


@query("impact_levels_audited", "SELECT scope, id, min(depth) AS depth FROM up GROUP BY scope, id", _LEVELS.format(edges="audit"), recursive=True)
def _(t, a):
    return traversal.impact_levels(t, node(t, a), "calls", 4, evidence=True)


@query("impact_of_change")
def _(t, a):
    return traversal.impact_of_change(t, node(t, a), "calls", 4, 100)


_CLOSURE = "links AS (SELECT DISTINCT scope, src AS id, dst_scope AS base_scope, dst AS base FROM resolved WHERE kind_name = 'inherits'), up(scope, id, base_scope, base) AS (SELECT * FROM links UNION SELECT u.scope, u.id, l.base_scope, l.base FROM up u JOIN links l ON l.scope = u.base_scope AND l.id = u.base)"


@query("inheritance_closure", "SELECT * FROM up", _CLOSURE, recursive=True)
def _(t):
    return traversal.ancestors_by_relation(t, "inherits").drop("depth")


# ---- path tracing

_HOPS = "hops AS (SELECT a.scope, a.src, a.dst_scope, a.dst, a.kind_name, a.scope || '/' || a.src AS a, a.dst_scope || '/' || a.dst AS b, max(v.confidence) AS confidence FROM audit a JOIN g_evidence v ON v.scope = a.scope AND v.src = a.src AND v.dst = a.dst AND v.kind_name = a.kind_name GROUP BY ALL)"
_SHOWN = "list_aggregate(path_ids, 'string_agg', '>') AS path, list_aggregate(kinds, 'string_agg', '>') AS kinds, confidence, n AS n_hops"


def _shown():
    return [F.concat_ws(">", F.transform("path_ids", lambda x: x.cast("string"))).alias("path"), F.concat_ws(">", "kinds").alias("kinds"), "confidence", "n_hops", "ends_at"]


_INTO = _HOPS + """, back(head, nodes, path_ids, kinds, confidence, n) AS (SELECT a, [a, b], [src, dst], [kind_name], confidence, 1 FROM hops WHERE kind_name = 'calls' AND a <> b AND b = (SELECT scope || '/' || id FROM anchor)
UNION ALL SELECT h.a, list_prepend(h.a, k.nodes), list_prepend(h.src, k.path_ids), list_prepend(h.kind_name, k.kinds), least(k.confidence, h.confidence), k.n + 1 FROM back k JOIN hops h ON h.b = k.head WHERE h.kind_name = 'calls' AND k.n < 8 AND NOT list_contains(k.nodes, h.a))"""


@query("trace_call_path", f"SELECT {_SHOWN}, (SELECT id FROM anchor) AS ends_at FROM back", _INTO, recursive=True)
def _(t, a):
    callers = traversal.auditable(t, ["calls"]).select("scope", F.col("src").alias("id"))
    return trace.paths_into(t, callers, node(t, a), "calls").select(*_shown())


_FLOW = trace.Automaton("bound", "typed", (("bound", "binds-path", "entry"), ("entry", "calls", "code"), ("code", "calls", "code"), ("code", "uses-type", "typed")))
_FLOW_SQL = _HOPS + """, moves(state, kind_name, next_state) AS (VALUES ('bound', 'binds-path', 'entry'), ('entry', 'calls', 'code'), ('code', 'calls', 'code'), ('code', 'uses-type', 'typed')),
walk(spot, state, nodes, path_ids, kinds, confidence, n, ends_at) AS (SELECT h.b, m.next_state, [h.a, h.b], [h.src, h.dst], [h.kind_name], h.confidence, 1, h.dst FROM hops h JOIN moves m ON m.kind_name = h.kind_name AND m.state = 'bound' WHERE h.a <> h.b
UNION ALL SELECT h.b, m.next_state, list_append(w.nodes, h.b), list_append(w.path_ids, h.dst), list_append(w.kinds, h.kind_name), least(w.confidence, h.confidence), w.n + 1, h.dst FROM walk w JOIN hops h ON h.a = w.spot JOIN moves m ON m.kind_name = h.kind_name AND m.state = w.state WHERE w.n < 8 AND NOT list_contains(w.nodes, h.b))"""


@query("trace_automaton", f"SELECT {_SHOWN}, ends_at FROM walk WHERE state = 'typed'", _FLOW_SQL, recursive=True)
def _(t):
    starts = traversal.auditable(t, ["binds-path"]).select("scope", F.col("src").alias("id")).distinct()
    return trace.every_path(t, starts, _FLOW, max_depth=8).select(*_shown())
