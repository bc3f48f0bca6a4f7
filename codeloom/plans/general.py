"""Queries of the general training-data problems: orphans, hierarchies, skewed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators.hierarchy import descendants, find_cycles, live_nodes, resolve_hierarchy
from codeloom.operators.orphans import find_orphans, report_orphans
from codeloom.operators.skew import call_loads, find_heavy, reference_loads
from codeloom.session import read_table


def _tables(spark, sf_dir, *names):
    return [read_table(spark, sf_dir, n) for n in names]


def p1_all(spark, sf_dir):
    return find_orphans(*_tables(spark, sf_dir, "refs", "symbols", "files", "shared_symbols"))


def p1_found(spark, sf_dir):
    return p1_all(spark, sf_dir).select("table_name", "field_name", "row_id", "period").distinct()


def p1_report(spark, sf_dir):
    return report_orphans(p1_all(spark, sf_dir))


def p3_found(spark, sf_dir):
    return find_cycles(*_tables(spark, sf_dir, "symbols"))


def p3_paths(spark, sf_dir):
    solved = resolve_hierarchy(live_nodes(*_tables(spark, sf_dir, "symbols")))
    text = F.concat_ws("/", F.transform("path", lambda x: F.coalesce(x, F.lit(""))))
    path = F.when(F.col("path").isNotNull(), text)
    return solved.select("id", path.alias("path"), "depth", "root_id", "cycle_id")


def p3_descendants(spark, sf_dir):
    return descendants(resolve_hierarchy(live_nodes(*_tables(spark, sf_dir, "symbols"))))


def p4_found(spark, sf_dir):
    return find_heavy(*_tables(spark, sf_dir, "refs", "edges", "symbols", "shared_symbols"))


def p4_counts(spark, sf_dir):
    refs, edges, symbols, shared = _tables(spark, sf_dir, "refs", "edges", "symbols", "shared_symbols")
    parts = [("refs", reference_loads(refs, symbols, shared)), ("calls", call_loads(edges, symbols, shared))]
    both = [d.select(F.lit(m).alias("measure"), "symbol_id", "name", "n") for m, d in parts]
    return both[0].unionByName(both[1])


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p4_found": p4_found, "p4_counts": p4_counts}

_P1 = """
WITH ends AS (
  SELECT 'refs' AS table_name, 'symbol_id' AS field_name, 'symbols' AS target, scope_id, symbol_id AS key, id AS row_id, seen_at AS seen FROM refs WHERE symbol_id IS NOT NULL
  UNION ALL SELECT 'refs', 'file_id', 'files', scope_id, file_id, id, seen_at FROM refs WHERE file_id IS NOT NULL
  UNION ALL SELECT 'symbols', 'file_id', 'files', scope_id, file_id, id, added_at FROM symbols WHERE file_id IS NOT NULL AND deleted_at IS NULL
), kept AS (
  SELECT *, date_trunc('month', seen) + INTERVAL 1 MONTH AS month_end FROM ends
  WHERE NOT (field_name = 'symbol_id' AND key IN (SELECT id FROM shared_symbols))
), records AS (
  SELECT 'symbols' AS target, scope_id, id AS key, min(added_at) FILTER (WHERE deleted_at IS NULL) AS since, count(*) FILTER (WHERE deleted_at IS NULL) AS live, max(deleted_at) AS died FROM symbols GROUP BY scope_id, id
  UNION ALL SELECT 'files', scope_id, id, min(added_at) FILTER (WHERE deleted_at IS NULL), count(*) FILTER (WHERE deleted_at IS NULL), max(deleted_at) FROM files GROUP BY scope_id, id
), judged AS (
  SELECT table_name, field_name, row_id, strftime(seen, '%Y-%m') AS period,
    CASE WHEN r.key IS NULL THEN 'missing' WHEN r.live = 0 AND r.died >= k.month_end THEN 'deleted-later' WHEN r.live = 0 THEN 'deleted' WHEN r.since IS NULL OR r.since >= k.month_end THEN 'late' END AS reason
  FROM kept k LEFT JOIN records r ON k.target = r.target AND k.scope_id = r.scope_id AND k.key = r.key
), broken AS (SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL)
"""
_P3 = """
WITH RECURSIVE live AS (
  SELECT id, arg_max(container_id, coalesce(added_at, TIMESTAMP '1900-01-01')) AS container_id, arg_max(name, coalesce(added_at, TIMESTAMP '1900-01-01')) AS name
  FROM symbols WHERE deleted_at IS NULL GROUP BY id
), nodes AS (SELECT a.id, b.id AS parent, a.name FROM live a LEFT JOIN live b ON a.container_id = b.id),
tree AS (
  SELECT id, coalesce(name, '') AS path, 0 AS depth, id AS root_id, [id] AS ancestors FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, t.path || '/' || coalesce(n.name, ''), t.depth + 1, t.root_id, list_append(t.ancestors, n.id) FROM nodes n JOIN tree t ON n.parent = t.id
), lost AS (SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
walk AS (
  SELECT id AS start, id AS spot, 0 AS step, false AS closed FROM lost
  UNION SELECT w.start, l.parent, w.step + 1, l.parent = w.start FROM walk w JOIN lost l ON w.spot = l.id WHERE NOT w.closed AND w.step < 1000
), circles AS (SELECT start AS id, min(spot) AS cycle_id FROM walk WHERE start IN (SELECT start FROM walk WHERE closed) GROUP BY start),
cycles AS (SELECT w.start AS id, min(c.cycle_id) AS cycle_id FROM walk w JOIN circles c ON w.spot = c.id GROUP BY w.start)
"""
_P4 = """
WITH names AS (SELECT id AS symbol_id, max(name) AS name FROM (SELECT id, name FROM symbols UNION ALL SELECT id, name FROM shared_symbols) GROUP BY id),
r AS (SELECT symbol_id, count(DISTINCT id) AS n FROM refs WHERE symbol_id IS NOT NULL GROUP BY symbol_id),
c AS (SELECT dst AS symbol_id, count(*) AS n FROM (SELECT DISTINCT dst, scope_id, src FROM edges WHERE replace(lower(trim(kind_name)), '_', '-') = 'calls' AND dst IS NOT NULL AND src IS NOT NULL) GROUP BY dst),
counts AS (
  SELECT 'refs' AS measure, symbol_id, name, coalesce(n, 0)::BIGINT AS n FROM names FULL JOIN r USING (symbol_id)
  UNION ALL SELECT 'calls', symbol_id, name, coalesce(n, 0)::BIGINT FROM names FULL JOIN c USING (symbol_id)
)
"""
SQL = {
    "p1_found": _P1 + "SELECT DISTINCT table_name, field_name, row_id, period FROM broken",
    "p1_report": _P1 + "SELECT table_name, field_name, period, reason, count(*) AS n_rows FROM broken GROUP BY ALL",
    "p3_found": _P3 + "SELECT id, cycle_id FROM cycles",
    "p3_paths": _P3 + """SELECT id, path, depth, root_id, NULL::BIGINT AS cycle_id FROM tree
UNION ALL SELECT id, NULL, NULL, NULL, cycle_id FROM cycles""",
    "p3_descendants": _P3 + """SELECT ancestor_id, id AS descendant_id, depth - lvl + 1 AS distance
FROM (SELECT id, depth, unnest(ancestors) AS ancestor_id, unnest(range(1, len(ancestors) + 1))::INTEGER AS lvl FROM tree) WHERE ancestor_id <> id""",
    "p4_found": _P4 + """SELECT measure, symbol_id FROM counts WHERE measure = 'refs' AND n > 0 AND n * 100 >= 2 * (SELECT count(DISTINCT id) FROM refs WHERE symbol_id IS NOT NULL)
UNION ALL SELECT measure, symbol_id FROM counts WHERE measure = 'calls' AND n > 0 AND n * 100 >= 2 * (SELECT sum(n) FROM counts WHERE measure = 'calls')""",
    "p4_counts": _P4 + "SELECT measure, symbol_id, name, n FROM counts",
}
