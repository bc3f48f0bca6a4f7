"""Queries of merges, derived projections, rules and payload questions over the projected model, with SQL.

Each merge is asked for the rows it leaves, not for counts alone, so that cascades are compared too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import format as fmt
from codeloom.operators import aggregate, interop, lookup, merge, payload, rpc, traversal, ui
from codeloom.plans.facts import _IMPORTS, _facts
from codeloom.plans.graph import anchor, graph_sql, node
from codeloom.session import read_table
from codeloom.tables import stored

QUERIES = {}
SQL = {}


def query(name, sql=None, more="", recursive=False):
    """Register a function of the model (and, if it takes one, the anchor row) as a query."""

    def register(build):
        def run(spark, sf_dir):
            t = stored(spark, sf_dir)
            if build.__code__.co_argcount == 1:
                return build(t)
            return build(t, t.once("anchor", lambda: anchor(t).first()))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = graph_sql(sql, more, recursive)
        return build

    return register


def _files(t, condition):
    return t.files.filter(condition).select("scope", F.col("id").alias("file_id"))


def _by_key(t, edges):
    """Edges with the canonical keys of both symbols, where both exist in the edge's scope."""
    key = lambda side: t.symbols.select("scope", F.col("id").alias(side), F.col("canonical_key").alias(f"{side}_key"))
    return edges.join(key("src"), ["scope", "src"]).join(key("dst"), ["scope", "dst"])


# ---- deletion and clearing

#: Evidence that stays, edges that lost some, and the edges that are left with their payload.
_LEFT = """lost AS (SELECT DISTINCT scope, src, dst, kind_name FROM g_evidence v WHERE {out}), rest AS (SELECT * FROM g_evidence v WHERE NOT ({out})),
firsts AS (SELECT scope, src, dst, kind_name, arg_min(payload, id) AS payload FROM rest GROUP BY scope, src, dst, kind_name),
kept AS (SELECT e.scope, e.src, e.dst, e.dst_scope, e.kind_name, CASE WHEN l.src IS NULL THEN e.payload ELSE nullif(f.payload, '') END AS payload FROM resolved e LEFT JOIN lost l USING (scope, src, dst, kind_name) LEFT JOIN firsts f USING (scope, src, dst, kind_name) WHERE l.src IS NULL OR f.src IS NOT NULL)"""
_OWNED = "(v.scope, v.producing_file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 7 = 0)"
_DEAD = "dead AS (SELECT scope, id FROM g_symbols WHERE (scope, file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 7 = 0))"


@query("merge_delete_edges", "SELECT scope, src, dst, kind_name, payload FROM kept WHERE (scope, src) NOT IN (SELECT (scope, id) FROM dead) AND (dst_scope, dst) NOT IN (SELECT (scope, id) FROM dead)", _LEFT.format(out=_OWNED) + ", " + _DEAD)
def _(t):
    return merge.delete_files(t, _files(t, "id % 7 = 0")).edges


@query("merge_delete_cascade", """SELECT 'symbols' AS part, count(*) AS n, count(container_id) AS m FROM (SELECT CASE WHEN (scope, container_id) IN (SELECT (scope, id) FROM dead) THEN NULL ELSE container_id END AS container_id FROM g_symbols WHERE (scope, id) NOT IN (SELECT (scope, id) FROM dead))
UNION ALL SELECT 'edge_evidence', count(*), count(DISTINCT (src, dst)) FROM rest r WHERE (r.scope, r.src) NOT IN (SELECT (scope, id) FROM dead) AND (r.scope, r.dst) NOT IN (SELECT (scope, id) FROM dead)
UNION ALL SELECT 'diagnostics', count(*), count(DISTINCT file_id) FROM g_diagnostics d WHERE (d.scope, d.file_id) NOT IN (SELECT (scope, id) FROM g_files WHERE id % 7 = 0)
UNION ALL SELECT 'symbol_history', count(*), count(DISTINCT last_author) FROM g_history h WHERE (h.scope, h.symbol_id) NOT IN (SELECT (scope, id) FROM dead)""", _LEFT.format(out=_OWNED) + ", " + _DEAD)
def _(t):
    left = merge.delete_files(t, _files(t, "id % 7 = 0"))
    count = lambda rows, name, m: rows.agg(F.count("*").alias("n"), m.alias("m")).select(F.lit(name).alias("part"), "n", "m")
    parts = [count(left.symbols, "symbols", F.count("container_id")), count(left.edge_evidence, "edge_evidence", F.count_distinct(F.struct("src", "dst"))), count(left.diagnostics, "diagnostics", F.count_distinct("file_id")), count(left.symbol_history, "symbol_history", F.count_distinct("last_author"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("merge_clear_producer", "SELECT scope, src, dst, kind_name, payload FROM kept", _LEFT.format(out="(v.scope, v.producing_file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 3 = 0) AND v.producer = 'compiler'"))
def _(t):
    return merge.clear_producer(t, "compiler", _files(t, "id % 3 = 0")).edges


@query("merge_reconcile", "SELECT scope, id, CASE WHEN (scope, container_id) IN (SELECT (scope, id) FROM dropped) THEN NULL ELSE container_id END AS container_id FROM g_symbols WHERE (scope, id) NOT IN (SELECT (scope, id) FROM dropped)", "dropped AS (SELECT scope, id FROM g_symbols WHERE (scope, file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 5 = 0) AND id % 2 = 1)")
def _(t):
    return merge.reconcile_declarations(t, _files(t, "id % 5 = 0"), t.symbols.filter("id % 2 = 0").select("scope", "canonical_key")).symbols.select("scope", "id", "container_id")


# ---- replacement and insertion

@query("merge_set_framework", "SELECT scope, id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'xunit' END ELSE test_framework END AS test_framework FROM g_symbols")
def _(t):
    changes = t.symbols.filter("id % 4 = 0").select("scope", "id", F.when(F.col("id") % 8 == 0, "xunit").alias("test_framework"))
    return merge.set_column(t.symbols, changes, "test_framework").select("scope", "id", "test_framework")


@query("merge_insert_refs", "SELECT scope, kind, count(*) + count(*) FILTER (WHERE id % 3 = 0) AS n FROM g_refs GROUP BY ALL")
def _(t):
    more = t.refs.filter("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000_000_000)
    return merge.insert_refs(t.refs, more).groupBy("scope", "kind").agg(F.count("*").alias("n"))


_FRESH = "fresh AS (SELECT scope, id AS src, container_id AS dst FROM g_symbols WHERE kind_name = 'method' AND id % 5 = 0 AND container_id IS NOT NULL)"


@query("merge_insert_edges", "SELECT l.scope, n.src, n.dst, 'tests' AS kind_name, l.file_id AS producing_file_id, l.path AS file_path, l.start_line, l.end_line, 0 AS confidence, 'legacy-declaration' AS producer, 'p' AS payload FROM fresh n JOIN located l ON l.scope = n.scope AND l.id = n.src", _FRESH)
def _(t):
    new = t.symbols.filter("kind_name = 'method' and id % 5 = 0 and container_id is not null").select("scope", F.col("id").alias("src"), F.col("container_id").alias("dst"), F.lit("tests").alias("kind_name"), F.lit("p").alias("payload"))
    out = merge.insert_edges(t, new.unionByName(new), t.edge_evidence.limit(0))
    logical = out.edges.filter("kind_name = 'tests' and payload = 'p'").select("scope", "src", "dst")
    proofs = out.edge_evidence.filter("producer = 'legacy-declaration'").join(logical, ["scope", "src", "dst"])
    return proofs.select("scope", "src", "dst", "kind_name", "producing_file_id", "file_path", "start_line", "end_line", "confidence", "producer", "payload")


_NEW = "new AS (SELECT DISTINCT e.scope, e.src, e.dst FROM resolved e JOIN located a ON a.scope = e.scope AND a.id = e.src JOIN g_symbols b ON b.scope = e.scope AND b.id = e.dst WHERE e.kind_name = 'inherits' AND {which})"


def _replacement(t, edges):
    """Facts that say 'references' where the edges say 'inherits', at the source's declaration."""
    place = lookup.located(t).select("scope", F.col("id").alias("src"), F.col("file_id").alias("producing_file_id"), F.col("path").alias("file_path"), "start_line", "start_col", "end_line", "end_col")
    return _by_key(t, edges).join(place, ["scope", "src"]).select("scope", "src_key", "dst_key", F.lit("references").alias("kind_name"), "producing_file_id", "file_path", "start_line", "start_col", "end_line", "end_col", F.lit(2).alias("confidence"), F.lit("x").alias("payload"))


@query("merge_replace_producer_scope", "SELECT scope, src, dst, kind_name, payload FROM kept UNION ALL SELECT scope, src, dst, 'references', 'x' FROM new", _LEFT.format(out="v.scope = (SELECT scope FROM anchor) AND v.producer = 'syntax'") + ", " + _NEW.format(which="e.scope = (SELECT scope FROM anchor)"))
def _(t, a):
    facts = _replacement(t, t.edges.filter((F.col("kind_name") == "inherits") & (F.col("scope") == a["scope"])))
    return merge.replace_producer(t, "syntax", facts, scope=a["scope"]).edges


@query("merge_replace_producer_files", "SELECT scope, src, dst, kind_name, payload FROM kept UNION ALL SELECT scope, src, dst, 'references', 'x' FROM new", _LEFT.format(out="(v.scope, v.producing_file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 4 = 0) AND v.producer = 'syntax'") + ", " + _NEW.format(which="a.file_id % 4 = 0"))
def _(t):
    inside = lookup.located(t).filter("file_id % 4 = 0").select("scope", F.col("id").alias("src"))
    facts = _replacement(t, t.edges.filter("kind_name = 'inherits'").join(inside, ["scope", "src"], "left_semi"))
    return merge.replace_producer(t, "syntax", facts, _files(t, "id % 4 = 0")).edges


_MARKS = "marks AS (SELECT scope, id * 10 + 5 AS id, id AS symbol_id, 'New' AS name, 'test' AS flavor FROM g_symbols WHERE (scope, file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 5 = 0) AND id % 3 = 0)"
_MARKED = "SELECT scope, id, symbol_id, name, flavor FROM g_annotations a WHERE NOT (flavor IN ('test', 'csharp-attribute') AND (scope, symbol_id) IN (SELECT (scope, id) FROM g_symbols WHERE (scope, file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 5 = 0))) UNION ALL SELECT * FROM marks"


def _new_marks(t, symbols):
    return symbols.select("scope", (F.col("id") * 10 + 5).alias("id"), F.col("id").alias("symbol_id"), F.lit("New").alias("name"), F.lit("New").alias("full_name"), F.lit("test").alias("flavor"), F.lit("[]").alias("args_json"), F.lit(None).cast("long").alias("attribute_symbol_id"))


def _marked(t):
    files = _files(t, "id % 5 = 0")
    return files, _new_marks(t, t.symbols.join(files, ["scope", "file_id"], "left_semi").filter("id % 3 = 0"))


@query("merge_replace_annotations", _MARKED, _MARKS)
def _(t):
    files, marks = _marked(t)
    return merge.replace_annotations(t, files, ["test", "csharp-attribute"], marks).select("scope", "id", "symbol_id", "name", "flavor")


@query("merge_replace_projection", "SELECT 'annotations' AS part, flavor AS name, count(*) AS n FROM (" + _MARKED + ") GROUP BY ALL UNION ALL SELECT 'edges', kind_name, count(*) FROM kept GROUP BY ALL", _LEFT.format(out="(v.scope, v.producing_file_id) IN (SELECT (scope, id) FROM g_files WHERE id % 5 = 0) AND v.producer = 'compiler'") + ", " + _MARKS)
def _(t):
    files, marks = _marked(t)
    out = merge.replace_file_projection(t, "compiler", files, ["test", "csharp-attribute"], _replacement(t, t.edges.limit(0)), marks)
    count = lambda rows, column, part: rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return count(out.annotations, "flavor", "annotations").union(count(out.edges, "kind_name", "edges"))


@query("merge_native_snapshot", "SELECT 'annotations' AS part, flavor AS name, count(*) AS n FROM (SELECT scope, symbol_id, flavor FROM g_annotations WHERE NOT (scope = (SELECT scope FROM anchor) AND flavor = 'test') UNION ALL SELECT scope, id, 'test' FROM g_symbols WHERE scope = (SELECT scope FROM anchor) AND id % 3 = 0) GROUP BY ALL UNION ALL SELECT 'edges', kind_name, count(*) FROM (SELECT scope, src, dst, kind_name FROM kept UNION ALL SELECT scope, src, dst, 'references' FROM new) GROUP BY ALL",
       _LEFT.format(out="v.scope = (SELECT scope FROM anchor) AND v.producer = 'syntax' AND (v.scope, v.producing_file_id) IN (SELECT (scope, id) FROM g_files)") + ", " + _NEW.format(which="e.scope = (SELECT scope FROM anchor)"))
def _(t, a):
    mine = lambda rows: rows.filter(F.col("scope") == a["scope"])
    facts = _replacement(t, mine(t.edges).filter("kind_name = 'inherits'"))
    out = merge.replace_native_snapshot(t, "syntax", mine(t.files).select("scope").distinct(), ["test"], facts, _new_marks(t, mine(t.symbols).filter("id % 3 = 0")))
    count = lambda rows, column, part: rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return count(out.annotations, "flavor", "annotations").union(count(out.edges, "kind_name", "edges"))


@query("merge_file_facts", "SELECT s.scope, s.id, CASE WHEN f.id IS NULL THEN s.signature ELSE 'again' END AS signature, s.test_framework, CASE WHEN f.id IS NULL THEN s.container_id ELSE b.id END AS container_id FROM g_symbols s LEFT JOIN (SELECT scope, id FROM g_files WHERE id % 7 = 0) f ON f.scope = s.scope AND f.id = s.file_id LEFT JOIN g_symbols b ON b.scope = s.scope AND b.id = s.container_id")
def _(t):
    few = t.files.filter("id % 7 = 0")
    inside = t.symbols.join(few.select("scope", F.col("id").alias("file_id"), "path"), ["scope", "file_id"])
    boxes = t.symbols.select("scope", F.col("id").alias("container_id"), F.col("canonical_key").alias("container_key"))
    sent = inside.join(boxes, ["scope", "container_id"], "left").withColumn("signature", F.lit("again")).drop("id", "file_id", "container_id")
    edges = _replacement(t, t.edges.limit(0)).withColumn("producer", F.lit("compiler")).drop("producing_file_id")
    marks = t.annotations.limit(0).withColumn("symbol_key", F.lit(""))
    refs = t.refs.limit(0).withColumn("symbol_key", F.lit("")).withColumn("path", F.lit(""))
    out = merge.replace_file_facts(t, few, sent, edges, marks.drop("id", "symbol_id", "attribute_symbol_id"), refs.drop("id", "symbol_id", "file_id"))
    return out.symbols.select("scope", "id", "signature", "test_framework", "container_id")


@query("merge_replace_diagnostics", "SELECT code, count(*) AS n FROM (SELECT code FROM g_diagnostics d WHERE (scope, file_id) NOT IN (SELECT (scope, id) FROM g_files WHERE id % 4 = 0) UNION ALL SELECT 'NEW' FROM g_files WHERE id % 4 = 0) GROUP BY code")
def _(t):
    files = _files(t, "id % 4 = 0")
    none = F.lit(None).cast("long")
    new = files.select("scope", F.col("file_id").alias("id"), none.alias("symbol_id"), "file_id", F.lit(3).alias("severity"), F.lit("NEW").alias("code"), F.lit("m").alias("message"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    return merge.replace_diagnostics(t, files, new).groupBy("code").agg(F.count("*").alias("n"))


@query("merge_upsert_history", "SELECT scope, symbol_id, CASE WHEN symbol_id % 6 = 0 THEN 'zed' ELSE last_author END AS last_author, last_authored_at + CASE WHEN symbol_id % 6 = 0 THEN 1 ELSE 0 END AS last_authored_at FROM g_history UNION ALL SELECT scope, id, 'new', 5 FROM g_symbols WHERE id % 30 = 1")
def _(t):
    again = t.symbol_history.filter("symbol_id % 6 = 0").withColumn("last_author", F.lit("zed")).withColumn("last_authored_at", F.col("last_authored_at") + 1)
    none = F.lit(None)
    new = t.symbols.filter("id % 30 = 1").select("scope", F.col("id").alias("symbol_id"), none.cast("string").alias("last_commit_sha"), F.lit("new").alias("last_author"), F.lit(5).cast("long").alias("last_authored_at"), F.lit(1).alias("line_count"), none.cast("binary").alias("blamed_content_sha"))
    return merge.upsert_history(t, again.unionByName(new)).select("scope", "symbol_id", "last_author", "last_authored_at")


@query("merge_baselines", "SELECT scope, canonical_key AS symbol_canonical_key, CASE WHEN kind_name = 'operator' THEN 'old' ELSE 'first' END AS contract_json, CASE WHEN kind_name = 'operator' THEN 9 ELSE 1 END::BIGINT AS observed_at FROM g_symbols WHERE kind_name = 'operator' OR (kind_name = 'method' AND id % 9 = 0)")
def _(t):
    row = lambda rows, text, at: rows.select("scope", F.col("canonical_key").alias("symbol_canonical_key"), F.lit(text).alias("contract_json"), F.lit("f").alias("file_path"), F.lit(at).cast("long").alias("observed_at"))
    some = t.symbols.filter("kind_name = 'operator' or (kind_name = 'method' and id % 9 = 0)")
    new = row(some, "later", 2).unionByName(row(some, "first", 1))
    return merge.insert_baselines(row(t.symbols.filter("kind_name = 'operator'"), "old", 9), new).select("scope", "symbol_canonical_key", "contract_json", "observed_at")


_BASE = "northlight/code-embed-base/64"
_HELD = f"held AS (SELECT symbol_id, arg_max(content_hash, embedded_at) AS content_hash FROM symbol_embeddings WHERE model_version = '{_BASE}' AND symbol_id IS NOT NULL AND embedded_at IS NOT NULL AND content_hash IS NOT NULL GROUP BY symbol_id)"


def _held(spark, d):
    rows = read_table(spark, d, "symbol_embeddings").filter((F.col("model_version") == _BASE) & F.col("symbol_id").isNotNull() & F.col("embedded_at").isNotNull() & F.col("content_hash").isNotNull())
    last = rows.groupBy("symbol_id").agg(F.max_by("content_hash", "embedded_at").alias("content_hash"))
    return last.select(F.lit("all").alias("scope"), "symbol_id", F.lit(None).cast("array<float>").alias("embedding"), "content_hash", F.lit(_BASE).alias("model_version"))


SQL["embedding_gate"] = graph_sql("SELECT symbol_id FROM held WHERE symbol_id % 2 = 0 UNION ALL SELECT symbol_id + 1000000000 FROM held WHERE symbol_id % 3 = 0", _HELD)


def _embedding_gate(spark, d):
    held = _held(spark, d)
    wanted = held.select("scope", "symbol_id", F.when(F.col("symbol_id") % 2 == 0, F.unhex(F.lit("00"))).otherwise(F.col("content_hash")).alias("content_hash"))
    new = held.filter("symbol_id % 3 = 0").select("scope", (F.col("symbol_id") + 1_000_000_000).alias("symbol_id"), "content_hash")
    return merge.to_embed(wanted.unionByName(new), held, _BASE).select("symbol_id")


SQL["embedding_upsert_prune"] = graph_sql("SELECT h.symbol_id, h.symbol_id % 2 = 0 AS fresh FROM held h WHERE EXISTS (SELECT 1 FROM g_symbols s WHERE s.id = h.symbol_id)", _HELD)


def _embedding_upsert_prune(spark, d):
    held, t = _held(spark, d), stored(spark, d)
    fresh = held.filter("symbol_id % 2 = 0").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    ids = t.symbols.select(F.lit("all").alias("scope"), "id").distinct()
    return merge.prune_embeddings(merge.upsert_embeddings(held, fresh), ids).select("symbol_id", F.col("embedding").isNotNull().alias("fresh"))


QUERIES |= {"embedding_gate": _embedding_gate, "embedding_upsert_prune": _embedding_upsert_prune}


# ---- lookups and traversal

@query("annotations_of", "SELECT a.scope, a.id, a.symbol_id, a.name, a.flavor FROM g_annotations a JOIN g_symbols s ON s.scope = a.scope AND s.id = a.symbol_id WHERE s.scope = (SELECT scope FROM anchor) AND s.file_id = (SELECT file_id FROM anchor)")
def _(t, a):
    few = t.symbols.filter((F.col("scope") == a["scope"]) & (F.col("file_id") == a["file_id"])).select("scope", "id")
    return lookup.annotations_of(t, few).select("scope", "id", "symbol_id", "name", "flavor")


@query("evidence_by_producer", "SELECT p AS producer, EXISTS (SELECT 1 FROM g_evidence v WHERE v.producer = p) AS found FROM (VALUES ('compiler'), ('nobody')) x(p)")
def _(t):
    return t.files.sparkSession.createDataFrame([(p, lookup.has_evidence_by(t, p)) for p in ("compiler", "nobody")], "producer string, found boolean")


_MOST_CALLING = "caller AS (SELECT scope, src FROM audit WHERE kind_name IN ('calls', 'uses-type') GROUP BY scope, src ORDER BY count(*) DESC, src, scope LIMIT 1)"
_OUTBOUND = "SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name AS symbol_kind, l.path, l.start_line FROM audit e JOIN located l ON l.scope = e.scope AND l.id = e.dst WHERE (e.scope, e.src) IN (SELECT (scope, src) FROM caller) AND e.kind_name IN ({kinds}) ORDER BY e.kind_name, path, start_line, e.src, e.dst, e.scope LIMIT {n}"


def _most_calling(t):
    per = traversal.auditable(t, ["calls", "uses-type"]).groupBy("scope", F.col("src").alias("id")).count()
    return per.orderBy(F.desc("count"), "id", "scope").limit(1).select("scope", "id")


@query("auditable_callees", _OUTBOUND.format(kinds="'calls'", n=1000), _MOST_CALLING)
def _(t):
    return traversal.adjacent(t, _most_calling(t), "calls", False, True, 1000)


@query("outbound_by_kinds", _OUTBOUND.format(kinds="'calls', 'uses-type', 'inherits'", n=1024), _MOST_CALLING)
def _(t):
    return traversal.adjacent_by_kinds(t, _most_calling(t), ["calls", "uses-type", "inherits"])


@query("overall_status", "SELECT scope, src, CASE WHEN count(DISTINCT kind_name) = 1 THEN max(kind_name) ELSE 'matched' END AS status FROM g_edges GROUP BY scope, src")
def _(t):
    return aggregate.overall_status(t.edges, ["scope", "src"], "kind_name")


_AS_UI = """ren AS (SELECT scope, src, dst, dst_scope, CASE kind_name WHEN 'calls' THEN 'handles-event' WHEN 'instantiates' THEN 'uses-resource' WHEN 'uses-type' THEN 'command-executes' ELSE kind_name END AS kind_name, replace(replace(payload, '"call-site"', '"event"'), '"path"', '"key"') AS payload FROM resolved),
named AS (SELECT s.scope, s.id, s.canonical_key, s.fqn, s.start_line, f.path FROM g_symbols s LEFT JOIN g_files f ON f.scope = s.scope AND f.id = s.file_id)"""
_JSON = "json_extract_string(CASE WHEN json_valid(e.payload) THEN e.payload END, '$.{}')"


def _as_ui(t):
    """Calls as event handlers, instantiations as uses of resources, uses of types as commands' targets."""
    kind = F.col("kind_name")
    kind = F.when(kind == "calls", "handles-event").when(kind == "instantiates", "uses-resource").when(kind == "uses-type", "command-executes").otherwise(kind)
    text = F.replace(F.replace(F.col("payload"), F.lit('"call-site"'), F.lit('"event"')), F.lit('"path"'), F.lit('"key"'))
    return t.with_tables(edges=t.edges.withColumn("kind_name", kind).withColumn("payload", text))


@query("find_event_handlers", f"SELECT e.scope, s.fqn AS src_fqn, d.fqn AS dst_fqn, {_JSON.format('event')} AS event, NULL::VARCHAR AS command, s.path AS src_path, s.start_line AS src_line FROM ren e JOIN named s ON s.scope = e.scope AND s.id = e.src JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst WHERE e.kind_name = 'handles-event' AND {_JSON.format('event')} = 'local' ORDER BY s.path NULLS FIRST, s.start_line NULLS FIRST, s.fqn, d.fqn, e.src, e.dst LIMIT 50", _AS_UI)
def _(t):
    return payload.find_event_handlers(_as_ui(t), event="local")


@query("find_resource_references", f"SELECT e.scope, e.kind_name, s.fqn AS src_fqn, d.fqn AS dst_fqn, {_JSON.format('key')} AS key, s.path AS src_path, s.start_line AS src_line FROM ren e JOIN named s ON s.scope = e.scope AND s.id = e.src JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst WHERE e.kind_name = 'uses-resource' AND {_JSON.format('key')} = 'Items[0].Name' ORDER BY s.path NULLS FIRST, s.start_line NULLS FIRST, s.fqn, d.fqn, e.src, e.dst LIMIT 50", _AS_UI)
def _(t):
    return payload.find_resource_references(_as_ui(t), key="Items[0].Name")


@query("check_resources", f"""SELECT scope, src_fqn, key, n AS n_definitions, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 THEN 'missing' ELSE 'matched' END AS status FROM (
SELECT e.scope, s.fqn AS src_fqn, {_JSON.format('key')} AS key, count(DISTINCT CASE WHEN d.id IS NOT NULL THEN d.scope || '/' || d.id END) AS n FROM ren e JOIN named s ON s.scope = e.scope AND s.id = e.src LEFT JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst WHERE e.kind_name = 'uses-resource' GROUP BY ALL)""", _AS_UI)
def _(t):
    return ui.check_resources(_as_ui(t), limit=None)


@query("trace_command", f"SELECT e.scope, s.fqn AS src_fqn, d.fqn AS dst_fqn, {_JSON.format('key')} AS command, h.fqn AS handler_fqn FROM (SELECT * REPLACE (replace(payload, '\"event\"', '\"key\"') AS payload) FROM ren) e JOIN named s ON s.scope = e.scope AND s.id = e.src JOIN named d ON d.scope = e.dst_scope AND d.id = e.dst LEFT JOIN (SELECT * FROM ren WHERE kind_name = 'command-executes') x ON x.scope = e.dst_scope AND x.src = e.dst LEFT JOIN named h ON h.scope = x.dst_scope AND h.id = x.dst WHERE e.kind_name = 'binds-path'", _AS_UI)
def _(t):
    seen = _as_ui(t)
    text = F.replace(F.replace(F.col("payload"), F.lit('"event"'), F.lit('"command"')), F.lit('"key"'), F.lit('"command"'))
    return ui.trace_command(seen.with_tables(edges=seen.edges.withColumn("payload", text)), limit=None)


_AS_RPC = "CASE {c}kind_name WHEN 'calls' THEN 'grpc-calls' WHEN 'uses-type' THEN 'implements-rpc' WHEN 'inherits' THEN 'rpc-dispatches-to' ELSE {c}kind_name END"


@query("trace_rpc", "SELECT *, (SELECT least(count(*), 8) FROM g_evidence v WHERE v.scope = r.scope AND v.src = r.src AND v.dst = r.dst AND " + _AS_RPC.format(c="v.") + " = r.kind_name) AS n_evidence FROM (SELECT DISTINCT * FROM rows ORDER BY kind_name, path, start_line, src, dst, scope LIMIT 64) r",
       "named AS (SELECT scope, id, canonical_key FROM g_symbols), rpcs AS (SELECT scope, src, dst, dst_scope, " + _AS_RPC.format(c="") + """ AS kind_name FROM audit WHERE kind_name IN ('calls', 'uses-type', 'inherits')),
every_one AS (SELECT scope, id FROM anchor UNION SELECT dst_scope, dst FROM rpcs WHERE kind_name IN ('grpc-calls', 'implements-rpc') AND (scope, src) IN (SELECT (scope, id) FROM anchor)),
rows AS (SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name AS symbol_kind, l.path, l.start_line FROM rpcs e JOIN located l ON l.scope = e.scope AND l.id = e.src WHERE (e.dst_scope, e.dst) IN (SELECT (scope, id) FROM every_one)
UNION SELECT e.scope, e.src, e.dst, e.kind_name, l.fqn, l.kind_name, l.path, l.start_line FROM rpcs e JOIN located l ON l.scope = e.scope AND l.id = e.dst WHERE (e.scope, e.src) IN (SELECT (scope, id) FROM every_one))""")
def _(t, a):
    kind = F.col("kind_name")
    kind = F.when(kind == "calls", "grpc-calls").when(kind == "uses-type", "implements-rpc").when(kind == "inherits", "rpc-dispatches-to").otherwise(kind)
    seen = t.with_tables(edges=t.edges.withColumn("kind_name", kind), edge_evidence=t.edge_evidence.withColumn("kind_name", kind))
    return rpc.trace_rpc(seen, a["canonical_key"]).withColumn("n_evidence", F.size("evidence").cast("long")).drop("evidence", "truncated_evidence")


# ---- impact, in the order of a queue

def _impact_sql(depth: int = 4, limit: int = 100) -> tuple[str, str]:
    order = "e.kind_name, l.path, l.start_line, l.start_col, e.src, e.scope"
    parts = ["hop AS (SELECT scope, src, dst, max(confidence) AS confidence FROM (SELECT * FROM g_evidence WHERE kind_name = 'calls' QUALIFY row_number() OVER (PARTITION BY scope, src, dst ORDER BY file_path, start_line, start_col, id) <= 21) GROUP BY ALL)",
             "f0 AS (SELECT scope, id, 0 AS depth, 1 AS place, NULL::BIGINT AS predecessor, id::VARCHAR AS path, 9 AS confidence FROM anchor)", "done0 AS (SELECT * FROM f0)"]
    for d in range(1, depth + 1):
        parts += [
            f"s{d} AS (SELECT e.scope, e.src, f.id AS predecessor, f.place AS from_place, f.path || '>' || e.src AS path, least(f.confidence, h.confidence) AS confidence, row_number() OVER (PARTITION BY e.dst_scope, e.dst ORDER BY {order}) AS branch FROM audit e JOIN located l ON l.scope = e.scope AND l.id = e.src JOIN f{d - 1} f ON f.scope = e.dst_scope AND f.id = e.dst JOIN hop h ON h.scope = e.scope AND h.src = e.src AND h.dst = e.dst WHERE e.kind_name = 'calls')",
            f"c{d} AS (SELECT * FROM s{d} WHERE branch <= {limit + 1} AND (scope, src) NOT IN (SELECT (scope, id) FROM done{d - 1}) QUALIFY row_number() OVER (PARTITION BY scope, src ORDER BY from_place, branch) = 1)",
            f"f{d} AS (SELECT scope, src AS id, {d} AS depth, row_number() OVER (ORDER BY from_place, branch) AS place, predecessor, path, confidence FROM c{d} QUALIFY place <= {limit + 1} - (SELECT count(*) FROM done{d - 1}))",
            f"done{d} AS (SELECT * FROM done{d - 1} UNION ALL SELECT * FROM f{d})",
        ]
    return f"SELECT scope, id, depth, predecessor, path, confidence FROM done{depth} WHERE depth > 0", ", ".join(parts)


@query("impact_in_order", *_impact_sql())
def _(t, a):
    rows = traversal.impact_of_change(t, node(t, a), "calls", 4, 100)
    return rows.select("scope", "id", "depth", "predecessor", F.concat_ws(">", F.transform("path_ids", lambda x: x.cast("string"))).alias("path"), "confidence")


# ---- rules of the native boundary

def _full_facts(t):
    """The facts of ``match_imports`` with parameters, callbacks and allocators."""
    imports, exports = _facts(t)
    param = lambda size, direction: F.array(F.struct(F.lit(0).alias("position"), F.lit("a").alias("name"), F.lit("int").alias("category"), direction.alias("direction"), F.lit(0).alias("pointer_depth"), size.alias("size"), F.lit(True).alias("signed"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("int").alias("array_length")))
    imports = imports.withColumn("params", param(F.lit(4), F.when(F.col("import_id") % 2 == 0, "in").otherwise("out")))
    size = F.when(F.col("export_id") % 5 == 0, 8).when(F.col("export_id") % 7 == 0, F.lit(None).cast("int")).otherwise(4)
    exports = exports.withColumn("params", param(size, F.lit("in"))).withColumn("return_allocation", F.when(F.col("export_id") % 3 == 0, "malloc"))
    retained = exports.filter("export_id % 2 = 0").select("scope", "export_id", F.lit(0).alias("position"))
    usages = imports.select("scope", "import_id", F.lit(0).alias("position"), F.when(F.col("import_id") % 3 == 0, True).alias("rooted"))
    releases = imports.filter("import_id % 2 = 0").select("scope", "import_id", F.when(F.col("import_id") % 4 == 0, "malloc").otherwise("cotaskmem").alias("release_family"))
    return imports, exports, retained, usages, releases


_SURE = _IMPORTS + ", sure AS (SELECT id, export_id AS e FROM firsts WHERE nth = 1 AND decision IN ('matched', 'source-matched'))"


@query("boundary_rules", """SELECT id AS import_id, e AS export_id, 'Interop003' AS rule, 'parameter 0: direction' AS detail FROM sure WHERE id % 2 = 1
UNION ALL SELECT id, e, 'Interop003', 'parameter 0: size' FROM sure WHERE e % 5 = 0
UNION ALL SELECT id, e, 'Interop003', 'parameter 0: unknown size' FROM sure WHERE e % 5 <> 0 AND e % 7 = 0
UNION ALL SELECT id, e, 'Interop004', 'callback at 0' FROM sure WHERE e % 2 = 0 AND id % 3 <> 0
UNION ALL SELECT id, e, 'Interop006', 'malloc / cotaskmem' FROM sure WHERE e % 3 = 0 AND id % 2 = 0 AND id % 4 <> 0""", _SURE)
def _(t):
    found = interop.boundary_findings(*_full_facts(t))
    return found.filter("rule in ('Interop003', 'Interop004', 'Interop006')").select("import_id", "export_id", "rule", "detail")


@query("publish_boundary_edges", "SELECT 'all' AS scope, id AS src, e AS dst, 'pinvoke-maps-to' AS kind_name FROM sure", _SURE)
def _(t):
    imports, exports = _facts(t)
    return interop.match_edges(imports, interop.match_imports(imports, exports)).select("scope", "src", "dst", "kind_name")


@query("stdcall_bytes", "SELECT kind_name, CASE WHEN count(*) FILTER (WHERE end_line IS NULL) > 0 THEN NULL ELSE sum(((end_line + 3) // 4) * 4) END::BIGINT AS n_bytes FROM g_symbols WHERE file_id IS NOT NULL GROUP BY kind_name")
def _(t):
    shape = interop.PARAM.removeprefix("struct<").removesuffix(">").split(",")
    sizes = F.struct(*[(F.col("end_line") if f.startswith("size:") else F.lit(None).cast(f.split(":")[1])).alias(f.split(":")[0]) for f in shape])
    per = t.symbols.filter("file_id is not null").groupBy("kind_name").agg(F.collect_list(sizes).alias("params"))  # stands for an argument list
    return per.select("kind_name", interop.stdcall_bytes().alias("n_bytes"))


# ---- renderings

@query("symbol_lines", """SELECT l.scope, l.id, l.path || ':' || l.start_line || ':' || l.start_col AS location,
concat_ws(' ', CASE l.accessibility WHEN 6 THEN 'public' WHEN 5 THEN 'protected internal' WHEN 4 THEN 'internal' WHEN 3 THEN 'protected' WHEN 2 THEN 'private protected' WHEN 1 THEN 'private' END, nullif(replace(coalesce(l.modifiers, ''), ',', ' '), ''), l.kind_name) AS label,
CASE WHEN flat <> '' THEN CASE WHEN length(first) > 120 THEN rtrim(first[1:120], ' ') || '…' ELSE first END END AS summary,
CASE WHEN h.symbol_id IS NOT NULL THEN 'last touched ' || strftime(make_timestamp(h.last_authored_at * 1000), '%Y-%m-%d') || ' by ' || h.last_author || ' (' || h.last_commit_sha[1:7] || ')' END AS history
FROM (SELECT *, CASE WHEN instr(flat, '. ') > 0 THEN flat[1:instr(flat, '. ')] ELSE flat END AS first FROM (SELECT *, trim(translate(xml_summary, chr(13) || chr(10), '  '), ' ') AS flat FROM located)) l LEFT JOIN g_history h ON h.scope = l.scope AND h.symbol_id = l.id""")
def _(t):
    history = t.symbol_history.withColumnRenamed("symbol_id", "id").select("scope", "id", "last_commit_sha", "last_author", "last_authored_at")
    rows = lookup.located(t).join(history, ["scope", "id"], "left")
    return rows.select("scope", "id", fmt.location().alias("location"), fmt.kind_with_attributes().alias("label"), fmt.one_line_summary().alias("summary"), fmt.history_line().alias("history"))
