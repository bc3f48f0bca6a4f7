"""What the plans of hot queries must look like, and that every query runs over the smallest tables."""

import os
import re
import shutil

import pytest

import __spark_entry__ as entry
from codeloom.operators import orphans, skew
from codeloom.session import read_table
from codeloom.tables import SOURCES, from_driver, stored
from conftest import SF

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_orphans_merge_after_one_shuffle(spark):
    tables = [read_table(spark, str(SF), n) for n in ("refs", "symbols", "files", "shared_symbols")]
    text = plan(orphans.merge_pointers(*orphans.code_graph_pointers(*tables)))
    assert text.count("REPARTITION_BY_NUM") == 1 and text.count("Window ") == 1
    assert "SortMergeJoin" not in text and "Python" not in text and "Arrow" not in text
    after = text.split("Window ")[1].split("REPARTITION_BY_NUM")[0]
    assert after.count("Exchange") <= 1  # the window takes the placement as it is
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert reads and not any("xml_summary" in r or "signature" in r for r in reads)


def test_skewed_counts_aggregate_where_rows_were_placed(spark):
    tables = [read_table(spark, str(SF), n) for n in ("refs", "symbols", "shared_symbols")]
    text = plan(skew.reference_loads(*tables))
    assert text.count("REPARTITION_BY_NUM") == 1 and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan(spark.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > 1000", o=read_table(spark, str(SF), "orders")))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_projection_is_written_once(spark, tmp_path):
    for name in SOURCES:
        at = SF / f"{name}.parquet"
        (shutil.copytree if at.is_dir() else shutil.copy)(at, tmp_path / at.name)
    t = stored(spark, str(tmp_path))
    assert stored(spark, str(tmp_path)) is t and t.files is t.files
    plain = from_driver(spark, str(tmp_path))
    assert sorted(map(tuple, t.edges.collect())) == sorted(map(tuple, plain.edges.collect())) and t.edges.schema == plain.edges.schema
    assert "model-" in t.edges.inputFiles()[0] and t.once("n", lambda: 1) == t.once("n", lambda: 2) == 1
    with pytest.raises(AttributeError):
        t.nothing
    os.utime(tmp_path / "scopes.parquet", (1, 1))  # another file: another projection
    assert stored(spark, str(tmp_path)) is not t


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


GRAPH = [n for n in entry.queries() if re.match(r"(v_|find_|list_|impact|trace_|module|sql_cube|merge_|match_|check_|boundary|symbol_lines|embedding_g)", n)]


@pytest.mark.parametrize("name", GRAPH)
def test_queries_run(spark, name):
    frame = entry.queries()[name](spark, str(SF))
    assert len(frame.columns) == len(set(frame.columns))
    frame.write.format("noop").mode("overwrite").save()
