"""Linking of remote procedure contracts with generated code, and checks against baselines.

contracts: scope, rpc_key, service, method, input, output, client_streaming, server_streaming.
generated: scope, symbol_id, service, method, role (client, server), overrides_base (bool); for proofs also
contained (bool: the generated container of the service is there), request, response and shape (unary,
client-streaming, server-streaming, duplex).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.scoped import with_target_scope
from codeloom.operators.traversal import EDGE, adjacent_by_kinds, auditable
from codeloom.tables import GraphTables

GENERATED_FLAVOR = "grpc-generated"
KINDS = ("grpc-calls", "implements-rpc", "rpc-dispatches-to")
GENERATED = "struct<service:string,method:string,role:string,contained:boolean,request:string,response:string,shape:string>"
FIELD = "struct<containing:string,type:string,number:int>"
CONTRACT = f"struct<kind:string,service:string,method:string,full_name:string,client_streaming:boolean,server_streaming:boolean,input:string,output:string,field:{FIELD}>"


def link(contracts: DataFrame, generated: DataFrame) -> DataFrame:
    """Edges between generated methods and contracts; a method links only if exactly one contract
    has its service and method name."""
    by = ["scope", "service", "method"]
    unique = contracts.withColumn("_n", F.count("*").over(W.partitionBy(*by))).filter("_n = 1").select(*by, "rpc_key")
    hit = generated.join(unique, by)
    edge = lambda rows, a, b, kind: rows.select("scope", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind_name"))
    clients, servers = hit.filter("role = 'client'"), hit.filter("role = 'server' and overrides_base")
    return edge(clients, "symbol_id", "rpc_key", "grpc-calls").union(edge(servers, "symbol_id", "rpc_key", "implements-rpc")).union(edge(servers, "rpc_key", "symbol_id", "rpc-dispatches-to")).distinct()


def contract_shape() -> Column:
    client, server = F.col("client_streaming"), F.col("server_streaming")
    return F.when(client & server, "duplex").when(client & ~server, "client-streaming").when(~client & server, "server-streaming").when(~client & ~server, "unary")


def prove(contracts: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proven, failures).  proven: scope, symbol_id, role, rpc_key of generated methods that exactly one
    contract of their service and method name fits by request, reply and streaming.  failures: scope,
    symbol_id, rpc_key, reason: 'evidence-missing' (no generated container), 'signature-mismatch' (no
    contract fits; rpc_key if only one has the name) or 'ambiguous' (several fit).  What a side doesn't
    say fits nothing.  Methods that no contract names are none of these."""
    by = ["scope", "service", "method"]
    named = generated.join(contracts.select(*by, "rpc_key", "input", "output", contract_shape().alias("_shape")), by)
    fits = (F.col("request") == F.col("input")) & (F.col("response") == F.col("output")) & (F.col("shape") == F.col("_shape"))
    per = named.groupBy("scope", "symbol_id", "role").agg(
        F.max(F.coalesce("contained", F.lit(False))).alias("contained"), F.count_distinct("rpc_key").alias("names"), F.min("rpc_key").alias("only"),
        F.count_distinct(F.when(fits, F.col("rpc_key"))).alias("fits"), F.min(F.when(fits, F.col("rpc_key"))).alias("rpc_key"),
    )
    sure = F.col("contained") & (F.col("fits") == 1)
    reason = F.when(~F.col("contained"), "evidence-missing").when(F.col("fits") == 0, "signature-mismatch").otherwise("ambiguous")
    failures = per.filter(~sure).select("scope", "symbol_id", F.when(F.col("names") == 1, F.col("only")).alias("rpc_key"), reason.alias("reason"))
    return per.filter(sure).select("scope", "symbol_id", "role", "rpc_key"), failures


def proven_edges(proven: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges between contracts and the code that uses them: who calls a proven client method calls the
    contract, who overrides a proven server method implements it and is what it dispatches to.  Only
    edges with evidence count."""
    backed = edges.filter(F.col("kind_name").isin("calls", "overrides-member")).join(evidence.select(*EDGE).distinct(), EDGE, "left_semi")
    used = backed.join(proven.withColumnRenamed("symbol_id", "dst"), ["scope", "dst"])
    edge = lambda rows, a, b, kind: rows.select("scope", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind_name"))
    callers, servers = used.filter("role = 'client' and kind_name = 'calls'"), used.filter("role = 'server' and kind_name = 'overrides-member'")
    return edge(callers, "src", "rpc_key", "grpc-calls").union(edge(servers, "src", "rpc_key", "implements-rpc")).union(edge(servers, "rpc_key", "src", "rpc-dispatches-to")).distinct()


def check_contracts(contracts: DataFrame, generated: DataFrame, fields: DataFrame, baseline_contracts: DataFrame, baseline_fields: DataFrame) -> DataFrame:
    """(scope, key, rule, detail): Grpc001 no implementation, Grpc002 a field's number changed,
    Grpc003 streaming changed.  fields: scope, full_name, number.  Baselines that lack a record say
    nothing about it."""
    by = ["scope", "service", "method"]
    servers = generated.filter("role = 'server' and overrides_base").select(*by).distinct()
    none = contracts.join(servers, by, "left_anti").select("scope", F.col("rpc_key").cast("string").alias("key"), F.lit("Grpc001").alias("rule"), F.lit("no implementation").alias("detail"))
    old = baseline_fields.select("scope", "full_name", F.col("number").alias("was"))
    moved = fields.join(old, ["scope", "full_name"]).filter("number != was")
    moved = moved.select("scope", F.col("full_name").cast("string").alias("key"), F.lit("Grpc002").alias("rule"), F.concat_ws(" -> ", F.col("was").cast("string"), F.col("number").cast("string")).alias("detail"))
    then = baseline_contracts.select("scope", "rpc_key", F.col("client_streaming").alias("c"), F.col("server_streaming").alias("s"))
    flipped = contracts.join(then, ["scope", "rpc_key"]).filter("client_streaming != c or server_streaming != s")
    flipped = flipped.select("scope", F.col("rpc_key").cast("string").alias("key"), F.lit("Grpc003").alias("rule"), F.lit("streaming changed").alias("detail"))
    return none.unionByName(moved).unionByName(flipped)


def check_signatures(contracts: DataFrame, generated: DataFrame) -> DataFrame:
    """Grpc004: a generated method whose request or reply type differs from its only contract's
    (generated with columns input, output; unknown types prove nothing)."""
    by = ["scope", "service", "method"]
    unique = contracts.withColumn("_n", F.count("*").over(W.partitionBy(*by))).filter("_n = 1").select(*by, "rpc_key", F.col("input").alias("want_in"), F.col("output").alias("want_out"))
    rows = generated.join(unique, by).filter("input != want_in or output != want_out")
    return rows.select("scope", F.col("rpc_key").cast("string").alias("key"), F.lit("Grpc004").alias("rule"), F.concat_ws(", ", "input", "output").alias("detail")).distinct()


def check_stored_contracts(t: GraphTables, flavor: str = "proto-contract") -> DataFrame:
    """The rules over contracts that are stored as annotations and baselines, and Grpc004 for generated
    methods (annotations of GENERATED_FLAVOR) whose signature differs from their only contract's."""
    read = lambda rows, column, key: rows.select("scope", F.col(key).alias("rpc_key"), F.from_json(column, CONTRACT).alias("c"))
    keys = t.symbols.select("scope", F.col("id").alias("symbol_id"), "canonical_key")
    now = read(t.annotations.filter(F.col("flavor") == flavor).join(keys, ["scope", "symbol_id"]), "args_json", "canonical_key")
    old = read(t.grpc_contract_baselines, "contract_json", "symbol_canonical_key")
    rpc = lambda rows: rows.filter("c.kind = 'rpc'").select("scope", "rpc_key", "c.service", "c.method", "c.client_streaming", "c.server_streaming")
    field = lambda rows: rows.filter("c.kind = 'field'").select("scope", "c.full_name", F.col("c.field.number").alias("number"))
    dispatch = t.edges.filter("kind_name = 'rpc-dispatches-to'").select("scope", F.col("src").alias("symbol_id")).join(keys, ["scope", "symbol_id"]).select("scope", F.col("canonical_key").alias("rpc_key"))
    servers = rpc(now).join(dispatch.distinct(), ["scope", "rpc_key"], "left_semi").select("scope", "service", "method", F.lit("server").alias("role"), F.lit(True).alias("overrides_base"))
    found = check_contracts(rpc(now), servers, field(now), rpc(old), field(old))
    made = t.annotations.filter(F.col("flavor") == GENERATED_FLAVOR).select("scope", "symbol_id", F.from_json("args_json", GENERATED).alias("g")).select("scope", "symbol_id", "g.*")
    whole = now.filter("c.kind = 'rpc'").select("scope", "rpc_key", "c.service", "c.method", "c.input", "c.output", "c.client_streaming", "c.server_streaming")
    _, failures = prove(whole, made)
    wrong = failures.filter("reason = 'signature-mismatch' and rpc_key is not null").select("scope", F.col("rpc_key").alias("key")).distinct()
    return found.unionByName(wrong.select("scope", "key", F.lit("Grpc004").alias("rule"), F.lit("generated signature differs").alias("detail")))


def trace_rpc(t: GraphTables, rpc: str, limit: int = 64, most: int = 8) -> DataFrame:
    """Callers and implementations of a contract, each with its first evidence, by kind, path and line.
    ``rpc`` is the exact key of the contract, or of a managed symbol that calls or implements some."""
    named = t.symbols.filter(F.col("canonical_key") == rpc).select("scope", "id")
    through = auditable(t, ["grpc-calls", "implements-rpc"]).join(named.withColumnRenamed("id", "src"), ["scope", "src"], "left_semi")
    contracts = with_target_scope(t, through.select("scope", "src", "dst"), "dst", "_to").select(F.col("_to").alias("scope"), F.col("dst").alias("id"))
    every = named.unionByName(contracts).distinct()
    rows = adjacent_by_kinds(t, every, list(KINDS), True, True).unionByName(adjacent_by_kinds(t, every, list(KINDS), False, True)).distinct()
    rows = rows.orderBy("kind_name", "path", "start_line", "src", "dst", "scope").limit(limit)
    order = W.partitionBy(*EDGE).orderBy("file_path", "start_line", "start_col", "id")
    proofs = t.edge_evidence.join(rows.select(*EDGE), EDGE, "left_semi").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most + 1)
    shown = F.when(F.col("nth") <= most, F.struct("nth", "file_path", F.col("start_line").alias("line")))
    lists = proofs.groupBy(*EDGE).agg(F.array_sort(F.collect_list(shown)).alias("evidence"), (F.max("nth") > most).alias("truncated_evidence"))
    return rows.join(lists, EDGE, "left")
