"""Queries of merges, drift, rules, search by vector, health and ad-hoc SQL over the projected model."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import adhoc, admin
from codeloom.operators import interop, lookup, merge, rpc, ui, vector
from codeloom.plans.graph import graph_sql
from codeloom.session import read_table
from codeloom.streaming.changes import debounce, hourly_changes
from codeloom.tables import stored as from_driver

QUERIES = {}
SQL = {}


def query(name, sql=None, more="", raw=False, recursive=False):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql if raw else graph_sql(sql, more, recursive)
        return build

    return register


# ---- merges: a third of the rows arrive again, changed, and a fifth is new

@query("merge_upsert_files", "SELECT scope, path, is_generated, last_indexed_at + CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS last_indexed_at, count(*) AS n FROM g_files GROUP BY ALL UNION ALL SELECT scope, path || '.new', 0, last_indexed_at, 1 FROM g_files WHERE id % 5 = 0")
def _(spark, d):
    t = from_driver(spark, d)
    again = t.files.filter("id % 3 = 0").withColumn("last_indexed_at", F.col("last_indexed_at") + 5)
    new = t.files.filter("id % 5 = 0").withColumn("path", F.concat("path", F.lit(".new"))).withColumn("is_generated", F.lit(0))
    out = merge.upsert_files(t.files, again.unionByName(new))
    return out.groupBy("scope", "path", "is_generated", "last_indexed_at").agg(F.count("*").alias("n"))


@query("merge_upsert_symbols", "SELECT scope, canonical_key, id, CASE WHEN id % 3 = 0 THEN 'new' ELSE signature END AS signature, test_framework, CASE WHEN id % 3 <> 0 THEN container_id END AS container_id FROM g_symbols")
def _(spark, d):
    t = from_driver(spark, d)
    again = t.symbols.filter("id % 3 = 0").withColumn("signature", F.lit("new")).withColumn("test_framework", F.lit(None).cast("string")).withColumn("container_id", F.lit(None).cast("long"))
    return merge.upsert_symbols(t.symbols, again).select("scope", "canonical_key", "id", "signature", "test_framework", "container_id")


_GONE = "gone AS (SELECT scope, id AS file_id FROM g_files WHERE id % 7 = 0), rest AS (SELECT * FROM g_evidence v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = v.scope AND g.file_id = v.producing_file_id) OR producer = 'syntax')"


@query("merge_clear_outgoing", "SELECT e.scope, e.src, e.dst, e.kind_name, CASE WHEN lost THEN nullif(first, '') ELSE e.payload END AS payload FROM (SELECT e.*, (SELECT arg_min(payload, id) FROM rest r WHERE r.scope = e.scope AND r.src = e.src AND r.dst = e.dst AND r.kind_name = e.kind_name) AS first, EXISTS (SELECT 1 FROM rest r WHERE r.scope = e.scope AND r.src = e.src AND r.dst = e.dst AND r.kind_name = e.kind_name) AS held, EXISTS (SELECT 1 FROM g_evidence r JOIN gone g ON g.scope = r.scope AND g.file_id = r.producing_file_id WHERE r.producer <> 'syntax' AND r.scope = e.scope AND r.src = e.src AND r.dst = e.dst AND r.kind_name = e.kind_name) AS lost FROM g_edges e) e WHERE held OR NOT lost", _GONE)
def _(spark, d):
    t = from_driver(spark, d)
    files = t.files.filter("id % 7 = 0").select("scope", F.col("id").alias("file_id"))
    return merge.clear_file_outgoing(t, files, ["syntax"]).edges


@query("merge_delete_files", "SELECT 'files' AS table_name, count(*) AS n_rows FROM g_files WHERE id % 7 <> 0 UNION ALL SELECT 'symbols', count(*) FROM left_symbols UNION ALL SELECT 'refs', count(*) FROM g_refs r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = r.scope AND g.file_id = r.file_id) AND NOT EXISTS (SELECT 1 FROM dead x WHERE x.scope = r.scope AND x.id = r.symbol_id) UNION ALL SELECT 'annotations', count(*) FROM g_annotations a WHERE NOT EXISTS (SELECT 1 FROM dead x WHERE x.scope = a.scope AND x.id = a.symbol_id)",
       _GONE + ", dead AS (SELECT s.scope, s.id FROM g_symbols s JOIN gone g ON g.scope = s.scope AND g.file_id = s.file_id), left_symbols AS (SELECT * FROM g_symbols s WHERE NOT EXISTS (SELECT 1 FROM dead x WHERE x.scope = s.scope AND x.id = s.id))")
def _(spark, d):
    t = from_driver(spark, d)
    files = t.files.filter("id % 7 = 0").select("scope", F.col("id").alias("file_id"))
    from codeloom.operators.aggregate import row_counts

    return row_counts(merge.delete_files(t, files), ("files", "symbols", "refs", "annotations"))


@query("purge_excluded", "SELECT 'files' AS table_name, count(*) AS n_rows FROM g_files WHERE path NOT ILIKE '%/text/%' UNION ALL SELECT 'symbols', count(*) FROM g_symbols s WHERE NOT EXISTS (SELECT 1 FROM g_files f WHERE f.scope = s.scope AND f.id = s.file_id AND f.path ILIKE '%/text/%')")
def _(spark, d):
    from codeloom.operators.aggregate import row_counts

    return row_counts(merge.purge_excluded(from_driver(spark, d), lambda path: path.ilike("%/text/%")), ("files", "symbols"))


@query("orphan_symbols", "SELECT scope, id, canonical_key FROM g_symbols s WHERE kind_name = 'field' AND NOT EXISTS (SELECT 1 FROM g_annotations a WHERE a.scope = s.scope AND a.symbol_id = s.id) AND NOT EXISTS (SELECT 1 FROM g_refs a WHERE a.scope = s.scope AND a.symbol_id = s.id) AND NOT EXISTS (SELECT 1 FROM g_edges a WHERE a.scope = s.scope AND (a.src = s.id OR a.dst = s.id)) AND NOT EXISTS (SELECT 1 FROM g_diagnostics a WHERE a.scope = s.scope AND a.symbol_id = s.id) AND NOT EXISTS (SELECT 1 FROM g_history a WHERE a.scope = s.scope AND a.symbol_id = s.id) AND NOT EXISTS (SELECT 1 FROM g_symbols a WHERE a.scope = s.scope AND a.container_id = s.id)")
def _(spark, d):
    t = from_driver(spark, d)
    return merge.orphan_symbols(t, t.symbols.filter("kind_name = 'field'").select("scope", "canonical_key"))


@query("drift", "SELECT scope, path, CASE WHEN id % 7 = 0 THEN 'removed' WHEN id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM g_files UNION ALL SELECT scope, path || '.new', 'added' FROM g_files WHERE id % 11 = 0")
def _(spark, d):
    t = from_driver(spark, d)
    seen = t.files.filter("id % 7 != 0").withColumn("content_sha256", F.when(F.col("id") % 5 == 0, F.unhex(F.lit("00"))).otherwise(F.col("content_sha256")))
    new = t.files.filter("id % 11 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    return merge.drift(t.files, seen.unionByName(new))


@query("scope_diff", "SELECT id, CASE WHEN isolated = 1 THEN 'removed' ELSE 'replaced' END AS change FROM scopes WHERE isolated = 1 OR status <> 'ready' UNION ALL SELECT 'extra', 'added'", raw=True)
def _(spark, d):
    old = read_table(spark, d, "scopes")
    new = old.filter("isolated = 0").withColumn("root", F.when(F.col("status") != "ready", F.concat("root", F.lit("/x"))).otherwise(F.col("root")))
    extra = old.limit(1).withColumn("id", F.lit("extra"))
    return merge.scope_diff(old, new.unionByName(extra))


@query("integrity", "SELECT 'symbols.file_id' AS \"check\", count(*) AS n_rows FROM g_symbols s WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_files f WHERE f.scope = s.scope AND f.id = s.file_id) UNION ALL SELECT 'symbols.container_id', count(*) FROM g_symbols s WHERE container_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_symbols f WHERE f.scope = s.scope AND f.id = s.container_id) UNION ALL SELECT 'refs.symbol_id', count(*) FROM g_refs s WHERE NOT EXISTS (SELECT 1 FROM g_symbols f WHERE f.scope IN (s.scope, 'shared') AND f.id = s.symbol_id) UNION ALL SELECT 'refs.file_id', count(*) FROM g_refs s WHERE NOT EXISTS (SELECT 1 FROM g_files f WHERE f.scope = s.scope AND f.id = s.file_id) UNION ALL SELECT 'edges.src', count(*) FROM g_edges s WHERE NOT EXISTS (SELECT 1 FROM g_symbols f WHERE f.scope = s.scope AND f.id = s.src) UNION ALL SELECT 'edges.dst', count(*) FROM g_edges s WHERE NOT EXISTS (SELECT 1 FROM g_symbols f WHERE f.scope IN (s.scope, 'shared') AND f.id = s.dst) UNION ALL SELECT 'annotations.symbol_id', 0 UNION ALL SELECT 'files repeated', 0 UNION ALL SELECT 'symbols repeated', 0 UNION ALL SELECT 'edges repeated', 0")
def _(spark, d):
    return merge.integrity(from_driver(spark, d))


@query("list_scopes", "SELECT s.id, s.name, s.root, s.isolated, s.status, s.status_message, (SELECT count(*) FROM g_files f WHERE f.scope = s.id) AS n_files, (SELECT count(*) FROM g_symbols f WHERE f.scope = s.id) AS n_symbols FROM scopes s")
def _(spark, d):
    return admin.list_scopes(from_driver(spark, d))


# ---- rules over facts read off the symbols

_IMPORTS = """imports AS (SELECT scope, id, name AS entry_point, id % 4 = 0 AS exact, CASE WHEN id % 2 = 0 THEN 'ansi' ELSE 'utf-16' END AS charset FROM g_symbols WHERE kind_name = 'method' AND canonical_key LIKE 'csharp:%'),
exports AS (SELECT id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN name || 'W' ELSE name || 'A' END AS export_name, CASE WHEN id % 17 <> 0 THEN 'core' END AS library, id % 5 <> 0 AS verified, id FROM g_symbols WHERE canonical_key LIKE 'cpp:%' AND kind_name IN ('method', 'function')),
tries AS (SELECT i.id, unnest(CASE WHEN exact THEN [entry_point] WHEN charset = 'ansi' THEN [entry_point, entry_point || 'A'] ELSE [entry_point || 'W', entry_point] END) AS spelling, unnest(CASE WHEN exact THEN [0] ELSE [0, 1] END) AS pos FROM imports i),
counted AS (SELECT t.id, t.pos, t.spelling, count(e.id) FILTER (WHERE e.library = 'core') AS hits, count(e.id) FILTER (WHERE e.library IS NULL) AS unknowns, min(e.id) FILTER (WHERE e.library = 'core') AS export_id, bool_or(e.verified) FILTER (WHERE e.library = 'core') AS verified FROM tries t LEFT JOIN exports e ON e.export_name = t.spelling GROUP BY ALL),
decided AS (SELECT *, CASE WHEN hits > 1 THEN 'ambiguous' WHEN unknowns > 0 THEN 'unknown' WHEN hits = 1 AND verified THEN 'matched' WHEN hits = 1 THEN 'source-matched' END AS decision FROM counted),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (decision IS NULL)::INTEGER, pos) AS nth FROM decided)"""


def _facts(t):
    target = [F.lit("win-x64").alias("rid"), F.lit("x64").alias("architecture"), F.lit("msvc").alias("abi"), F.lit(8).alias("pointer_size"), F.lit(None).cast(f"array<{interop.PARAM}>").alias("params")]
    imports = t.symbols.filter("kind_name = 'method' and canonical_key like 'csharp:%'").select(
        F.lit("all").alias("scope"), F.col("id").alias("import_id"), F.lit("C:\\lib\\Core.DLL").alias("library"), F.col("name").alias("entry_point"), F.when(F.col("id") % 3 == 0, "cdecl").otherwise("stdcall").alias("convention"),
        (F.col("id") % 4 == 0).alias("exact_spelling"), F.when(F.col("id") % 2 == 0, "ansi").otherwise("utf-16").alias("charset"), *target,
    )
    suffix = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "W").otherwise("A")
    exports = t.symbols.filter("kind_name in ('method', 'function') and canonical_key like 'cpp:%'").select(
        F.lit("all").alias("scope"), F.col("id").alias("export_id"), F.concat("name", suffix).alias("export_name"), F.when(F.col("id") % 17 != 0, "core.dll").alias("library"), (F.col("id") % 5 != 0).alias("binary_verified"),
        F.when(F.col("id") % 2 == 0, "cdecl").otherwise("vectorcall").alias("convention"), F.when(F.col("id") % 4 == 0, "throws").alias("exception_escape"), F.lit(None).cast("string").alias("return_allocation"), *target,
    )
    return imports, exports


@query("match_imports", "SELECT 'all' AS scope, id AS import_id, coalesce(decision, 'unmatched') AS outcome, CASE WHEN decision IN ('matched', 'source-matched') THEN export_id END AS export_id, CASE WHEN decision IS NOT NULL THEN spelling END AS spelling FROM firsts WHERE nth = 1", _IMPORTS)
def _(spark, d):
    return interop.match_imports(*_facts(from_driver(spark, d)))


@query("boundary_findings", "SELECT 'all' AS scope, f.id AS import_id, f.export_id, 'Interop001' AS rule, 'error' AS severity, (CASE WHEN f.id % 3 = 0 THEN 'cdecl' ELSE 'stdcall' END) || ' / vectorcall' AS detail FROM firsts f WHERE nth = 1 AND decision IN ('matched', 'source-matched') AND f.export_id % 2 = 1 UNION ALL SELECT 'all', f.id, f.export_id, 'Interop005', 'error', 'throws' FROM firsts f WHERE nth = 1 AND decision IN ('matched', 'source-matched') AND f.export_id % 4 = 0", _IMPORTS)
def _(spark, d):
    imports, exports = _facts(from_driver(spark, d))
    none = F.array().cast(f"array<{interop.PARAM}>")
    return interop.boundary_findings(imports.withColumn("params", none), exports.withColumn("params", none))


@query("publish_boundary", "SELECT 'interop-match' AS name, count(*) AS n FROM firsts WHERE nth = 1 UNION ALL SELECT 'pinvoke-maps-to', count(*) FROM firsts WHERE nth = 1 AND decision IN ('matched', 'source-matched')", _IMPORTS)
def _(spark, d):
    imports, exports = _facts(from_driver(spark, d))
    matches = interop.match_imports(imports, exports)
    marks, edges = interop.publish_boundary(imports, matches, interop.rule_convention(interop._pairs(imports, exports, matches)))
    return marks.filter("flavor = 'interop-match'").groupBy(F.col("flavor").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy("kind_name").agg(F.count("*").alias("n")))


_STRUCTS = """fields AS (SELECT c.id AS box, row_number() OVER (PARTITION BY c.id ORDER BY m.start_line, m.id) AS ord, m.id FROM g_symbols c JOIN g_symbols m ON m.scope = c.scope AND m.container_id = c.id WHERE m.kind_name = 'field' AND m.start_line IS NOT NULL)"""


@query("compare_structs", "SELECT box AS managed_id, -box AS native_id, CASE WHEN bool_or(id % 10 = 0) THEN 'incompatible' WHEN bool_or(id % 7 = 0) THEN 'unknown' ELSE 'compatible' END AS verdict FROM fields GROUP BY box", _STRUCTS)
def _(spark, d):
    t = from_driver(spark, d)
    from pyspark.sql import Window as W

    m = t.symbols.filter("kind_name = 'field' and container_id is not null and start_line is not null").join(t.symbols.select("scope", F.col("id").alias("container_id")), ["scope", "container_id"], "left_semi")
    m = m.withColumn("ord", F.row_number().over(W.partitionBy("container_id").orderBy("start_line", "id")).cast("int"))

    def side(size, sign):
        f = F.struct(F.col("ord").alias("order"), "name", F.lit("int").alias("category"), (F.col("ord") * 4).alias("offset"), size.alias("size"), F.lit(0).alias("pointer_depth"), F.lit(None).cast("int").alias("array_length"))
        rows = m.groupBy("container_id").agg(F.sort_array(F.collect_list(f)).alias("fields"))  # a type's own fields
        return rows.select(F.lit("all").alias("scope"), (F.col("container_id") * sign).alias("record_id"), F.col("container_id").alias("pair_id"), F.lit("struct").alias("kind"), F.lit(8).alias("size"), F.lit(4).alias("align"), F.lit(8).alias("pack"), "fields")

    native = F.when(F.col("id") % 10 == 0, 8).when(F.col("id") % 7 == 0, F.lit(None).cast("int")).otherwise(4)
    checks = interop.compare_structs(side(F.lit(4), 1), side(native, -1))
    return interop.struct_verdict(checks).select("managed_id", "native_id", "verdict")


_RPC = """contracts AS (SELECT id AS rpc_key, split_part(fqn, '.', 1) AS service, name AS method FROM g_symbols WHERE kind_name = 'operator' OR (kind_name = 'method' AND id % 9 = 0)),
uniq AS (SELECT * FROM contracts QUALIFY count(*) OVER (PARTITION BY service, method) = 1),
made AS (SELECT id AS symbol_id, split_part(fqn, '.', 1) AS service, name AS method, CASE WHEN id % 2 = 0 THEN 'client' ELSE 'server' END AS role FROM g_symbols WHERE kind_name IN ('method', 'function', 'operator'))"""


def _rpc(t):
    service = F.split("fqn", r"\.")[0]
    stream = lambda k: (F.col("id") % k == 0)
    contracts = t.symbols.filter("kind_name = 'operator' or (kind_name = 'method' and id % 9 = 0)").select(F.lit("all").alias("scope"), F.col("id").alias("rpc_key"), service.alias("service"), F.col("name").alias("method"), stream(2).alias("client_streaming"), stream(3).alias("server_streaming"))
    made = t.symbols.filter("kind_name in ('method', 'function', 'operator')").select(F.lit("all").alias("scope"), F.col("id").alias("symbol_id"), service.alias("service"), F.col("name").alias("method"), F.when(F.col("id") % 2 == 0, "client").otherwise("server").alias("role"), F.lit(True).alias("overrides_base"))
    return contracts, made


@query("rpc_link", "SELECT 'all' AS scope, m.symbol_id AS src, u.rpc_key AS dst, CASE WHEN role = 'client' THEN 'grpc-calls' ELSE 'implements-rpc' END AS kind_name FROM made m JOIN uniq u USING (service, method) UNION SELECT 'all', u.rpc_key, m.symbol_id, 'rpc-dispatches-to' FROM made m JOIN uniq u USING (service, method) WHERE role = 'server'", _RPC)
def _(spark, d):
    return rpc.link(*_rpc(from_driver(spark, d)))


@query("check_proto_contract", "SELECT 'all' AS scope, rpc_key::VARCHAR AS key, 'Grpc001' AS rule, 'no implementation' AS detail FROM contracts c WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.service = c.service AND m.method = c.method AND m.role = 'server') UNION ALL SELECT 'all', rpc_key::VARCHAR, 'Grpc003', 'streaming changed' FROM contracts WHERE rpc_key % 5 = 0 UNION ALL SELECT 'all', id::VARCHAR, 'Grpc002', (id % 8) || ' -> ' || (id % 8 + 1) FROM g_symbols WHERE kind_name = 'property' AND id % 6 = 0", _RPC)
def _(spark, d):
    t = from_driver(spark, d)
    contracts, made = _rpc(t)
    fields = t.symbols.filter("kind_name = 'property'").select(F.lit("all").alias("scope"), F.col("id").alias("full_name"), ((F.col("id") % 8) + (F.col("id") % 6 == 0).cast("long")).alias("number"))
    before = fields.withColumn("number", F.col("full_name") % 8)
    old = contracts.withColumn("client_streaming", F.col("client_streaming") != (F.col("rpc_key") % 5 == 0))
    return rpc.check_contracts(contracts, made, fields, old, before)


@query("test_framework", "SELECT scope, symbol_id AS id, 'nunit' AS framework FROM g_annotations WHERE name = 'Test'")
def _(spark, d):
    return ui.test_framework(from_driver(spark, d))


@query("trace_binding", "SELECT e.scope, e.kind_name, s.fqn AS src_fqn, d.fqn AS dst_fqn, json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.path') AS path, 'not-found' AS status, s.path AS src_path, s.start_line AS src_line FROM resolved e JOIN named s ON s.scope = e.scope AND s.id = e.src LEFT JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst WHERE e.kind_name = 'binds-path' AND contains(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.path'), 'Items')", "named AS (SELECT s.scope, s.id, s.canonical_key, s.fqn, s.start_line, f.path FROM g_symbols s LEFT JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id)")
def _(spark, d):
    t = from_driver(spark, d)
    return ui.trace_binding(t, binding="Items", limit=None)


@query("event_leaks", "SELECT DISTINCT scope, src, dst FROM g_edges e WHERE kind_name = 'calls' AND src % 2 = 0 AND dst % 2 = 0 AND NOT EXISTS (SELECT 1 FROM g_edges u WHERE u.kind_name = 'uses-type' AND u.scope = e.scope AND u.src = e.src AND u.dst = e.dst)")
def _(spark, d):
    t = from_driver(spark, d)
    as_event = lambda k: t.edges.filter(F.col("kind_name") == k).select("scope", F.col("src").alias("event"), F.col("dst").alias("handler"), (F.col("src") % 2 == 0).alias("is_static"), (F.col("dst") % 2 == 0).alias("handler_is_instance"))
    return ui.event_leaks(as_event("calls"), as_event("uses-type")).select("scope", F.col("event").alias("src"), F.col("handler").alias("dst"))


# ---- vectors

_BASE = "northlight/code-embed-base/64"


@query("semantic_search", f"""SELECT s.scope, v.symbol_id, s.fqn, v.score FROM (SELECT symbol_id, round(list_inner_product(e, q) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(q, q)), 6) AS score FROM vectors, (SELECT arg_min(e, symbol_id) AS q FROM vectors)) v JOIN g_symbols s ON s.id = v.symbol_id WHERE s.kind_name = 'method' ORDER BY score DESC, v.symbol_id LIMIT 20""",
       f"vectors AS (SELECT symbol_id, arg_max(embedding, embedded_at)::DOUBLE[] AS e FROM symbol_embeddings WHERE model_version = '{_BASE}' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY symbol_id)")
def _(spark, d):
    t = from_driver(spark, d)
    raw = read_table(spark, d, "symbol_embeddings").filter((F.col("model_version") == _BASE) & (F.size("embedding") == 64))
    sound = raw.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    vectors = sound.groupBy("symbol_id").agg(F.max_by("embedding", "embedded_at").alias("embedding"))
    one = vectors.orderBy("symbol_id").limit(1).first()
    return vector.semantic_search(t, vectors, [float(x) for x in one["embedding"]], 20, "method")


# ---- ad-hoc SQL

@query("query_graph", "SELECT s.kind_name AS kind, count(DISTINCT e.src) AS n_src, round(avg(e.n), 4) AS mean FROM (SELECT src, count(*) AS n FROM g_edges WHERE kind_name = 'calls' AND scope IN (SELECT id FROM scopes WHERE isolated = 0) GROUP BY src) e JOIN g_symbols s ON s.id = e.src AND s.scope IN (SELECT id FROM scopes WHERE isolated = 0) GROUP BY s.kind_name HAVING count(*) >= 2")
def _(spark, d):
    text = "WITH e AS (SELECT src, count(*) AS n FROM v_edges WHERE kind = @kind GROUP BY src) -- one; statement\nSELECT s.kind, count(DISTINCT e.src) AS n_src, round(avg(e.n), 4) AS mean FROM e JOIN v_symbols s ON s.id = e.src GROUP BY s.kind HAVING count(*) >= @least;"
    return adhoc.plan_query(spark, from_driver(spark, d), text, {"kind": "calls", "least": 2})


@query("top_reference_per_file", "SELECT scope, file_id, symbol_id, n FROM (SELECT scope, file_id, symbol_id, count(*) AS n, row_number() OVER (PARTITION BY scope, file_id ORDER BY count(*) DESC, symbol_id) AS nth FROM g_refs GROUP BY scope, file_id, symbol_id) WHERE nth <= 3")
def _(spark, d):
    text = "SELECT scope, file_id, symbol_id, n FROM (SELECT scope, file_id, symbol_id, count(*) AS n, row_number() OVER (PARTITION BY scope, file_id ORDER BY count(*) DESC, symbol_id) AS nth FROM v_references GROUP BY scope, file_id, symbol_id) WHERE nth <= 3"
    return adhoc.plan_query(spark, from_driver(spark, d), text, scope=",".join(r[0] for r in read_table(spark, d, "scopes").select("id").collect()))


# ---- streams, over static frames

def _changes(spark, d):
    rows = read_table(spark, d, "refs").filter("symbol_id is not null and file_id is not null")
    return rows.select(F.col("scope_id").alias("scope"), F.concat(F.lit("/f/"), F.col("file_id").cast("string")).alias("path"), F.col("seen_at").cast("timestamp").alias("ts"), F.when(F.col("symbol_id") % 2 == 0, "GitHeadChanged").otherwise("FileSystemEvent").alias("reason"))


@query("debounce", "WITH rows AS (SELECT scope_id AS scope, '/f/' || file_id AS path, seen_at AS ts, CASE WHEN symbol_id % 2 = 0 THEN 'GitHeadChanged' ELSE 'FileSystemEvent' END AS reason FROM refs WHERE symbol_id IS NOT NULL AND file_id IS NOT NULL), cut AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM rows WINDOW w AS (PARTITION BY scope, reason ORDER BY ts)), grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY scope, reason ORDER BY ts) AS g FROM cut) SELECT scope, reason, min(ts) AS started, count(DISTINCT path) AS n_paths FROM grouped GROUP BY scope, reason, g", raw=True)
def _(spark, d):
    return debounce(_changes(spark, d), "10 minutes").select("scope", "reason", F.col("started").cast("timestamp_ntz").alias("started"), F.size("paths").cast("long").alias("n_paths"))


@query("hourly_changes", "SELECT scope_id AS scope, date_trunc('hour', seen_at) AS hour, count(*) AS n FROM refs WHERE symbol_id IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL", raw=True)
def _(spark, d):
    return hourly_changes(_changes(spark, d)).select("scope", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


@query("usage_stats", "SELECT event_type AS tool, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors, round(avg(value), 3) AS avg_ms, max(value) AS max_ms, round(avg(length(props)), 3) AS avg_bytes FROM events GROUP BY event_type", raw=True)
def _(spark, d):
    from codeloom.operators.aggregate import usage_stats

    calls = read_table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"), F.length("props").alias("bytes"))
    return usage_stats(calls)


@query("sample_files")
def _(spark, d):
    return lookup.sample_files(from_driver(spark, d))
