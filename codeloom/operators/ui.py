"""Bindings, commands and resources of user interfaces, and rules about events and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.payload import payload_value, two_sided
from codeloom.operators.scoped import with_target_scope
from codeloom.tables import GraphTables

OUTCOME = "binding-outcome"
#: Attributes that mark tests, by framework (fixed values).
TEST_ATTRIBUTES = {
    "xunit": ("Fact", "Theory", "FactAttribute", "TheoryAttribute"),
    "mstest": ("TestMethod", "DataTestMethod", "TestMethodAttribute", "DataTestMethodAttribute"),
    "nunit": ("Test", "TestCase", "TestCaseSource", "TestAttribute", "TestCaseAttribute"),
}


def resolve_element(t: GraphTables, element: str) -> DataFrame:
    """(scope, id, fqn, element_status): symbols that a key, full name or name's end means; 'unique' if it
    is one, else 'ambiguous'."""
    exact = t.symbols.filter((F.col("canonical_key") == element) | (F.col("fqn") == element))
    found = exact if not exact.limit(1).isEmpty() else t.symbols.filter(F.col("fqn").endswith("." + element))
    one = found.limit(2).count() == 1
    return found.select("scope", "id", "fqn", F.lit("unique" if one else "ambiguous").alias("element_status"))


def _cut(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def trace_binding(t: GraphTables, element: str | None = None, binding: str | None = None, limit: int | None = 50, kinds=("binds-path",), key: str = "path") -> DataFrame:
    """Bindings of an element (key or name) or path, with the outcome that was recorded ('not-found'
    where none was); bindings of the older kind binds-to only if there is none of the newer.  The same
    binding comes out once.  An element that several symbols are is 'ambiguous': those come out, and
    none of their bindings."""
    columns = ["scope", "kind_name", "src_fqn", "dst_fqn", "path", "status", "src_path", "src_line"]
    rows = t.edges.withColumn("path", payload_value(key)).withColumn("_said", payload_value("status"))
    rows = rows if binding is None else rows.filter(F.contains(F.coalesce("path", F.lit("")), F.lit(binding)))
    if element is not None:
        meant = resolve_element(t, element)
        if not meant.filter("element_status = 'ambiguous'").limit(1).isEmpty():
            none = F.lit(None).cast("string")
            out = meant.select("scope", none.alias("kind_name"), F.col("fqn").alias("src_fqn"), none.alias("dst_fqn"), none.alias("path"), F.lit("ambiguous").alias("status"), none.alias("src_path"), F.lit(None).cast("int").alias("src_line"))
            return _cut(out.orderBy("src_fqn", "scope"), limit)
        rows = rows.join(meant.select("scope", F.col("id").alias("src")), ["scope", "src"], "left_semi")
    hits = two_sided(t, rows.filter(F.col("kind_name").isin(list(kinds))), "left")
    if hits.limit(1).isEmpty():
        hits = two_sided(t, rows.filter("kind_name = 'binds-to'"), "left")
    outcomes = t.annotations.filter(F.col("flavor") == OUTCOME).groupBy("scope", F.col("symbol_id").alias("src")).agg(F.max(F.get_json_object("args_json", "$.status")).alias("_outcome"))
    once = hits.withColumn("_nth", F.row_number().over(W.partitionBy("scope", "src", "dst", "path").orderBy("kind_name"))).filter("_nth = 1")
    done = once.join(outcomes, ["scope", "src"], "left").withColumn("status", F.lower(F.coalesce("_said", "_outcome", F.lit("not-found"))))
    return _cut(done.select(*columns).orderBy("src_path", "src_line", "src_fqn", "dst_fqn", "path", "scope"), limit)


def trace_command(t: GraphTables, element: str | None = None, command: str | None = None, limit: int | None = 50) -> DataFrame:
    """Bindings to commands, and what the commands execute."""
    bound = t.edges.filter("kind_name = 'binds-path'").withColumn("command", F.coalesce(payload_value("command"), payload_value("path")))
    bound = bound if command is None else bound.filter(F.contains(F.coalesce("command", F.lit("")), F.lit(command)))
    if element is not None:
        bound = bound.join(resolve_element(t, element).filter("element_status = 'unique'").select("scope", F.col("id").alias("src")), ["scope", "src"], "left_semi")
    runs = with_target_scope(t, t.edges.filter("kind_name = 'command-executes'").select("scope", "src", "dst"), "dst", "handler_scope")
    runs = runs.select(F.col("scope").alias("dst_scope"), F.col("src").alias("dst"), "handler_scope", F.col("dst").alias("handler"))
    both = two_sided(t, bound).join(runs, ["dst_scope", "dst"], "left")
    names = t.symbols.select(F.col("scope").alias("handler_scope"), F.col("id").alias("handler"), F.col("fqn").alias("handler_fqn"))
    done = both.join(names, ["handler_scope", "handler"], "left").select("scope", "src_fqn", "dst_fqn", "command", "handler_fqn")
    return _cut(done.orderBy("src_fqn", "dst_fqn", "command", "handler_fqn", "scope"), limit)


def check_resources(t: GraphTables, file: str | None = None, key: str | None = None, limit: int | None = 50, kinds=("uses-resource", "applies-style")) -> DataFrame:
    """Resource keys in use with the number of their definitions: missing, matched or ambiguous."""
    rows = two_sided(t, t.edges.filter(F.col("kind_name").isin(list(kinds))).withColumn("key", payload_value("key")), "left")
    rows = rows if key is None else rows.filter(F.col("key") == key)
    rows = rows if file is None else rows.filter(F.contains(F.coalesce("src_path", F.lit("")), F.lit(file)))
    per = rows.groupBy("scope", "src_fqn", "key").agg(F.count_distinct(F.when(F.col("dst_key").isNotNull(), F.struct("dst_scope", "dst"))).alias("n"))
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 0, "missing").otherwise("matched")
    return _cut(per.select("scope", "src_fqn", "key", F.col("n").alias("n_definitions"), status.alias("status")).orderBy("src_fqn", "key", "scope"), limit)


def event_leaks(subscriptions: DataFrame, removals: DataFrame) -> DataFrame:
    """Instance handlers on static events that are never removed (scope, event, handler, is_static,
    handler_is_instance; removals by scope, event, handler)."""
    risky = subscriptions.filter("is_static and handler_is_instance")
    return risky.join(removals.select("scope", "event", "handler").distinct(), ["scope", "event", "handler"], "left_anti")


def test_framework(t: GraphTables) -> DataFrame:
    """(scope, id, framework) of methods with a test attribute: xunit before mstest before nunit."""
    rank = F.lit(None).cast("int")
    for k, (_, names) in reversed(list(enumerate(TEST_ATTRIBUTES.items()))):
        rank = F.when(F.col("name").isin(*names), k).otherwise(rank)
    best = t.annotations.withColumn("rank", rank).filter("rank is not null").groupBy("scope", F.col("symbol_id").alias("id")).agg(F.min("rank").alias("rank"))
    return best.select("scope", "id", F.get(F.array(*[F.lit(f) for f in TEST_ATTRIBUTES]), F.col("rank")).alias("framework"))
