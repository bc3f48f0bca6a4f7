"""Relational features that ad-hoc SQL offers: the same statement runs on both engines."""

from __future__ import annotations

import re

from codeloom.session import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "refs", "symbols")

#: Statements in the common dialect of both engines.
STATEMENTS = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "shipping_priority": "SELECT o.o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10",
    "supplier_volume": "SELECT n.n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size <= 5 GROUP BY CUBE (p_brand, p_size)",
    "moving_window": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders",
    "rank_functions": "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS d, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q FROM supplier",
    "set_intersect": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000",
    "set_except": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "full_outer": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) b ON a.k = b.k",
    "semi_anti": "SELECT count(*) AS n FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_discount = 0)",
    "case_pivot": "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY o_orderpriority",
    "event_sessions": "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1' HOUR THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, session) z GROUP BY user_id",
    "distinct_aggregates": "SELECT scope_id, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT file_id) AS n_files, count(*) AS n FROM refs GROUP BY scope_id",
    "having_subquery": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_nationkey HAVING count(*) > 3",
}


def _run(statement: str):
    def run(spark, sf_dir):
        used = {t: read_table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", statement)}
        text = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], statement)
        return spark.sql(text, **used)

    return run


QUERIES = {f"sql_{k}": _run(s) for k, s in STATEMENTS.items()}
SQL = {f"sql_{k}": s for k, s in STATEMENTS.items()}
