"""Matching of managed imports with native exports, and rules about their boundary.

Facts are tables.  imports: scope, import_id, library, entry_point, convention, exact_spelling,
charset, rid, architecture, abi, pointer_size, params.  exports: scope, export_id, export_name,
library (null: unknown module), binary_verified, convention, rid, architecture, abi, pointer_size,
params, exception_escape, return_allocation.  params: array of structs (see PARAM).  Outcomes are
explicit words; what isn't known is 'unknown', never compatible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import located, top_match
from codeloom.session import cut
from codeloom.tables import GraphTables

PARAM = "struct<position:int,name:string,category:string,direction:string,pointer_depth:int,size:int,signed:boolean,encoding:string,array_length:int>"
FLAVORS = {"match": "interop-match", "finding": "interop-finding"}
TARGET = ["rid", "architecture", "abi", "pointer_size"]
RECORD_FLAVOR = "interop-abi-record"
_FIELD = "struct<order:int,name:string,category:string,offset:int,size:int,pointer_depth:int,array_length:int>"
RECORD = f"struct<kind:string,size:int,align:int,pack:int,rid:string,architecture:string,abi:string,pointer_size:int,fields:array<{_FIELD}>>"


def _is_windows(rid: str = "rid") -> Column:
    return F.lower(F.col(rid)).startswith("win")


def stdcall_bytes(params: str = "params") -> Column:
    """Bytes of the arguments, each rounded up to four; null if a size is unknown."""
    sizes = F.transform(params, lambda p: F.ceil(p["size"] / 4) * 4)
    unknown = F.exists(params, lambda p: p["size"].isNull())
    return F.when(~unknown, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x))


def library_name(column: str = "library", rid: str = "rid") -> Column:
    """File name; on Windows without .dll and letter case."""
    base = F.regexp_replace(F.col(column), r"^.*[/\\]", "")
    return F.when(_is_windows(rid), F.regexp_replace(F.lower(base), r"\.dll$", "")).otherwise(base)


def spellings() -> Column:
    """Names under which an import may be exported, best first."""
    e = F.col("entry_point")
    plain = (
        F.when(F.coalesce("exact_spelling", F.lit(False)) | ~_is_windows(), F.array(e))
        .when(F.col("charset") == "utf-16", F.array(F.concat(e, F.lit("W")), e))
        .when(F.col("charset") == "ansi", F.array(e, F.concat(e, F.lit("A"))))
        .otherwise(F.array(e))
    )
    size = stdcall_bytes()
    decorated = (F.col("architecture") == "x86") & (F.col("convention") == "stdcall") & size.isNotNull()
    both = F.flatten(F.transform(plain, lambda s: F.array(s, F.concat(F.lit("_"), s, F.lit("@"), size.cast("string")))))
    return F.when(decorated, both).otherwise(plain)


def same_target(a: str, b: str) -> Column:
    same = [F.lower(F.col(f"{a}.rid")).eqNullSafe(F.lower(F.col(f"{b}.rid")))]
    same += [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in TARGET[1:]]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return out


def match_imports(imports: DataFrame, exports: DataFrame, complete: bool = True) -> DataFrame:
    """(scope, import_id, outcome, export_id, spelling): matched (binary verified), source-matched,
    ambiguous, unmatched or unknown.

    The first spelling that decides wins.  Several exports of the import's library are ambiguous; a
    candidate of an unknown module makes it unknown; without any library match the next spelling is
    tried.  Same names on other targets only, an unknown stdcall size, or an incomplete universe of
    exports leave the outcome unknown.
    """
    i = imports.withColumn("_lib", library_name()).withColumn("_open", (F.col("architecture") == "x86") & (F.col("convention") == "stdcall") & stdcall_bytes().isNull())
    tried = i.select("*", F.posexplode(spellings()).alias("pos", "spelling")).alias("i")
    e = exports.withColumn("_lib", library_name()).alias("e")
    pairs = tried.join(e, (F.col("i.scope") == F.col("e.scope")) & (F.col("i.spelling") == F.col("e.export_name")), "left")
    named = F.col("e.export_id").isNotNull()
    fit = named & same_target("i", "e")
    hit, unknown = fit & (F.col("i._lib") == F.col("e._lib")), fit & F.col("e.library").isNull()
    by = pairs.groupBy(F.col("i.scope").alias("scope"), F.col("i.import_id").alias("import_id"), F.col("i.pos").alias("pos"), F.col("i.spelling").alias("spelling"), F.col("i._open").alias("open")).agg(
        F.count(F.when(named, 1)).alias("named"), F.count(F.when(fit, 1)).alias("fits"), F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(unknown, 1)).alias("unknowns"),
        F.min(F.when(hit, F.col("e.export_id"))).alias("export_id"), F.max(F.when(hit, F.col("e.binary_verified"))).alias("verified"),
    )
    decision = F.when(F.col("hits") > 1, "ambiguous").when(F.col("unknowns") > 0, "unknown").when((F.col("hits") == 1) & F.col("verified"), "matched").when(F.col("hits") == 1, "source-matched")
    decided = by.withColumn("decision", decision)
    first = F.min_by(F.struct("decision", "spelling", "export_id"), F.when(F.col("decision").isNotNull(), F.col("pos")))
    rows = decided.groupBy("scope", "import_id").agg(first.alias("r"), F.sum("named").alias("named"), F.sum("fits").alias("fits"), F.max("open").alias("open"))
    rest = F.when((F.col("named") > 0) & (F.col("fits") == 0), "unknown").when(F.col("open"), "unknown").when(F.lit(complete), "unmatched").otherwise("unknown")
    outcome = F.coalesce("r.decision", rest)
    sure = F.col("r.decision").isin("matched", "source-matched")
    return rows.select("scope", "import_id", outcome.alias("outcome"), F.when(sure, F.col("r.export_id")).alias("export_id"), F.when(F.col("r.decision").isNotNull(), F.col("r.spelling")).alias("spelling"))


def _pairs(imports: DataFrame, exports: DataFrame, matches: DataFrame) -> DataFrame:
    m = matches.filter(F.col("export_id").isNotNull()).select("scope", "import_id", "export_id")
    left = imports.select("scope", "import_id", *[F.col(c).alias(f"i_{c}") for c in imports.columns if c not in ("scope", "import_id")])
    right = exports.select("scope", "export_id", *[F.col(c).alias(f"e_{c}") for c in exports.columns if c not in ("scope", "export_id")])
    return m.join(left, ["scope", "import_id"]).join(right, ["scope", "export_id"])


def _finding(rows: DataFrame, rule: str, severity: Column, detail: Column) -> DataFrame:
    return rows.select("scope", "import_id", "export_id", F.lit(rule).alias("rule"), severity.alias("severity"), detail.alias("detail"))


def convention_family(column: str, architecture: str) -> Column:
    """On x64 and arm64 all conventions but vectorcall are the platform's one."""
    return F.when(F.col(architecture).isin("x64", "arm64") & (F.col(column) != "vectorcall"), "platform").otherwise(F.col(column))


def rule_convention(pairs: DataFrame) -> DataFrame:
    a, b = convention_family("i_convention", "i_architecture"), convention_family("e_convention", "e_architecture")
    rows = pairs.filter(a.isNull() | b.isNull() | (a != b))
    return _finding(rows, "Interop001", F.when(a.isNull() | b.isNull(), "warning").otherwise("error"), F.concat_ws(" / ", F.coalesce("i_convention", F.lit("unknown")), F.coalesce("e_convention", F.lit("unknown"))))


def rule_parameters(pairs: DataFrame) -> DataFrame:
    """Differences of count, direction, pointer depth, size, array length, sign, encoding and
    category at each position; unknown sizes and opaque types are warnings of their own."""
    counts = pairs.filter(F.size("i_params") != F.size("e_params"))
    out = _finding(counts, "Interop003", F.lit("warning"), F.lit("count"))
    left = pairs.select("scope", "import_id", "export_id", F.explode("i_params").alias("a")).withColumn("position", F.col("a.position"))
    right = pairs.select("scope", "import_id", "export_id", F.explode("e_params").alias("b")).withColumn("position", F.col("b.position"))
    both = left.join(right, ["scope", "import_id", "export_id", "position"])
    checks = [F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(c)) for c in ("direction", "pointer_depth", "size", "array_length", "signed", "encoding", "category")]
    checks.append(F.when(F.col("a.size").isNull() | F.col("b.size").isNull(), F.lit("unknown size")))
    checks.append(F.when((F.col("a.category") == "opaque") | (F.col("b.category") == "opaque"), F.lit("opaque")))
    each = both.select("scope", "import_id", "export_id", "position", F.explode(F.array_compact(F.array(*checks))).alias("what"))
    return out.unionByName(_finding(each, "Interop003", F.lit("warning"), F.concat(F.lit("parameter "), F.col("position").cast("string"), F.lit(": "), F.col("what"))))


def rule_callbacks(pairs: DataFrame, retained: DataFrame, usages: DataFrame) -> DataFrame:
    """retained: scope, export_id, position.  usages: scope, import_id, position, rooted."""
    kept = pairs.select("scope", "import_id", "export_id").join(retained, ["scope", "export_id"])
    rows = kept.join(usages.filter(~F.coalesce("rooted", F.lit(False))), ["scope", "import_id", "position"]).dropDuplicates(["scope", "import_id", "export_id", "position"])
    return _finding(rows, "Interop004", F.lit("warning"), F.concat(F.lit("callback at "), F.col("position").cast("string")))


def rule_exceptions(pairs: DataFrame) -> DataFrame:
    return _finding(pairs.filter("e_exception_escape is not null"), "Interop005", F.lit("error"), F.col("e_exception_escape"))


def rule_allocators(pairs: DataFrame, releases: DataFrame) -> DataFrame:
    """releases: scope, import_id, release_family."""
    rows = pairs.join(releases, ["scope", "import_id"]).filter("e_return_allocation is not null and release_family is not null and e_return_allocation != release_family")
    return _finding(rows, "Interop006", F.lit("warning"), F.concat_ws(" / ", "e_return_allocation", "release_family"))


def compare_structs(managed: DataFrame, native: DataFrame) -> DataFrame:
    """(scope, managed_id, native_id, aspect, ordinal, status): one row per check of two layouts.

    Both sides: scope, record_id, pair_id, kind, size, align, pack, fields (array of struct
    order, name, category, offset, size, pointer_depth, array_length), and if they say for which
    target, rid, architecture, abi and pointer_size.  status is compatible, incompatible or unknown
    (a side doesn't say).  A truth value that is one byte on one side and four on the other is the
    check 'field bool_size'.
    """
    a = managed.select("scope", "pair_id", F.col("record_id").alias("managed_id"), F.struct("kind", "size", "align", "pack", F.size("fields").alias("field_count")).alias("a"), F.col("fields").alias("fa"))
    b = native.select("scope", "pair_id", F.col("record_id").alias("native_id"), F.struct("kind", "size", "align", "pack", F.size("fields").alias("field_count")).alias("b"), F.col("fields").alias("fb"))
    both = a.join(b, ["scope", "pair_id"])

    def status(x, y):
        return F.when(x.isNull() | y.isNull(), "unknown").when(x == y, "compatible").otherwise("incompatible")

    keys = ["scope", "managed_id", "native_id"]
    whole = [F.struct(F.lit(c).alias("aspect"), F.lit(None).cast("int").alias("ordinal"), status(F.col(f"a.{c}"), F.col(f"b.{c}")).alias("status")) for c in ("kind", "size", "align", "pack", "field_count")]
    out = both.select(*keys, F.explode(F.array(*whole)).alias("r")).select(*keys, "r.*")
    if all(c in d.columns for d in (managed, native) for c in TARGET):
        left, right = (d.select("scope", "pair_id", F.col("record_id").alias(n), F.struct(F.lower("rid").alias("rid"), *TARGET[1:]).alias(x)) for d, n, x in ((managed, "managed_id", "x"), (native, "native_id", "y")))
        silent = F.greatest(*[F.col(f"{x}.{c}").isNull() for x in "xy" for c in TARGET])
        same = F.when(silent, "unknown").when(F.col("x") == F.col("y"), "compatible").otherwise("incompatible")
        out = out.unionByName(left.join(right, ["scope", "pair_id"]).select(*keys, F.lit("target").alias("aspect"), F.lit(None).cast("int").alias("ordinal"), same.alias("status")))
    left = both.select(*keys, F.explode("fa").alias("x")).withColumn("ordinal", F.col("x.order"))
    right = both.select(*keys, F.explode("fb").alias("y")).withColumn("ordinal", F.col("y.order"))
    fields = left.join(right, [*keys, "ordinal"], "full")
    each = [F.struct(F.lit(f"field {c}").alias("aspect"), F.when(F.col("x").isNull() | F.col("y").isNull(), "incompatible").otherwise(status(F.col(f"x.{c}"), F.col(f"y.{c}"))).alias("status")) for c in ("offset", "size", "category", "pointer_depth")]
    lengths = F.struct(F.lit("field array_length").alias("aspect"), F.when(F.col("x.array_length").eqNullSafe(F.col("y.array_length")), "compatible").otherwise("incompatible").alias("status"))
    truth = (F.col("x.category") == "bool") & (F.col("y.category") == "bool")
    bools = F.when(truth, F.struct(F.lit("field bool_size").alias("aspect"), status(F.col("x.size"), F.col("y.size")).alias("status")))
    return out.unionByName(fields.select(*keys, "ordinal", F.explode(F.array_compact(F.array(*each, lengths, bools))).alias("r")).select(*keys, "r.aspect", "ordinal", "r.status"))


def struct_verdict(checks: DataFrame) -> DataFrame:
    """Incompatible if any check is, else unknown if any is, else compatible."""
    rank = F.max(F.when(F.col("status") == "incompatible", 2).when(F.col("status") == "unknown", 1).otherwise(0))
    return checks.groupBy("scope", "managed_id", "native_id").agg(F.when(rank == 2, "incompatible").when(rank == 1, "unknown").otherwise("compatible").alias("verdict"))


#: Levels of nested records that are followed; deeper ones are unknown (fixed value).
NESTING = 32


def compare_nested(checks: DataFrame, managed: DataFrame, native: DataFrame, mapping: DataFrame) -> DataFrame:
    """The checks of ``compare_structs`` with those of nested records.

    managed and native: scope, record_id, ordinal, nested (the record that the field holds); mapping:
    scope, managed_id, native_id of records that are known to be the same.  Adds for each pair and field
    'nested identity' (incompatible if the managed one is known to be another native one, unknown if
    nothing is known) and 'nested layout' (the worst verdict of the nested pair and all below it; unknown
    below NESTING levels or where the pair has no checks), and 'cycle', incompatible, for pairs that
    hold themselves.
    """
    pair, inner = ["scope", "managed_id", "native_id"], ["scope", "m", "n"]
    a = managed.filter("nested is not null").select("scope", F.col("record_id").alias("managed_id"), "ordinal", F.col("nested").alias("m"))
    b = native.filter("nested is not null").select("scope", F.col("record_id").alias("native_id"), "ordinal", F.col("nested").alias("n"))
    known = checks.select(*pair).distinct()
    links = cut(known.join(a, ["scope", "managed_id"]).join(b, ["scope", "native_id", "ordinal"]).select(*pair, "ordinal", "m", "n"))
    same = mapping.select("scope", F.col("managed_id").alias("m"), F.col("native_id").alias("n")).distinct()
    mapped = same.select("scope", "m").distinct().withColumn("_mapped", F.lit(True))
    identity = links.join(same.withColumn("_same", F.lit(True)), inner, "left").join(mapped, ["scope", "m"], "left")
    status = F.when(F.col("_same"), "compatible").when(F.col("_mapped"), "incompatible").otherwise("unknown")
    out = checks.unionByName(identity.select(*pair, F.lit("nested identity").alias("aspect"), "ordinal", status.alias("status")))
    # the worst of a pair and of those below it, level by level until nothing changes
    rank = F.max(F.when(F.col("status") == "incompatible", 2).when(F.col("status") == "unknown", 1).otherwise(0)).alias("rank")
    worst, settled = cut(out.groupBy(*pair).agg(rank)), False
    for _ in range(NESTING):
        below = links.join(worst.toDF("scope", "m", "n", "_rank"), inner, "left").groupBy(*pair).agg(F.max(F.coalesce("_rank", F.lit(1))).alias("_below"))
        risen = cut(worst.join(below, pair, "left").select(*pair, F.greatest("rank", F.coalesce("_below", F.lit(0))).alias("rank"), (F.coalesce("_below", F.lit(0)) > F.col("rank")).alias("_rose")))
        settled = risen.filter("_rose").isEmpty()
        worst = risen.drop("_rose")
        if settled:
            break
    layout = links.join(worst.toDF("scope", "m", "n", "_rank"), inner, "left")
    word = F.when(F.col("_rank") == 2, "incompatible").when(F.col("_rank").isNull() | (F.col("_rank") == 1) | F.lit(not settled), "unknown").otherwise("compatible")
    out = out.unionByName(layout.select(*pair, F.lit("nested layout").alias("aspect"), "ordinal", word.alias("status")))
    # pairs that lead back to themselves
    step = cut(links.select(*pair, "m", "n").distinct())
    reach = seen = step
    for _ in range(NESTING):
        on = reach.join(step.toDF("scope", "m", "n", "_m", "_n"), inner).select(*pair, F.col("_m").alias("m"), F.col("_n").alias("n")).distinct()
        reach = cut(on.join(seen, [*pair, "m", "n"], "left_anti"))
        if reach.isEmpty():
            break
        seen = seen.unionByName(reach)
    circles = seen.filter((F.col("managed_id") == F.col("m")) & (F.col("native_id") == F.col("n"))).select(*pair).distinct()
    return out.unionByName(circles.select(*pair, F.lit("cycle").alias("aspect"), F.lit(None).cast("int").alias("ordinal"), F.lit("incompatible").alias("status")))


def boundary_findings(imports: DataFrame, exports: DataFrame, retained: DataFrame | None = None, usages: DataFrame | None = None, releases: DataFrame | None = None, complete: bool = True) -> DataFrame:
    pairs = _pairs(imports, exports, match_imports(imports, exports, complete))
    out = rule_convention(pairs).unionByName(rule_parameters(pairs)).unionByName(rule_exceptions(pairs))
    if retained is not None and usages is not None:
        out = out.unionByName(rule_callbacks(pairs, retained, usages))
    return out if releases is None else out.unionByName(rule_allocators(pairs, releases))


def match_edges(imports: DataFrame, matches: DataFrame) -> DataFrame:
    """pinvoke-maps-to edges of sure matches."""
    sure = matches.filter(F.col("outcome").isin("matched", "source-matched"))
    return sure.select("scope", F.col("import_id").alias("src"), F.col("export_id").alias("dst"), F.lit("pinvoke-maps-to").alias("kind_name"), F.to_json(F.struct("outcome", "spelling")).alias("payload"))


def struct_edges(matches: DataFrame, managed: DataFrame, native: DataFrame) -> DataFrame:
    """struct-maps-to edges: records that stand at the same place of a surely matched signature, where each
    is the other's only one.  managed: scope, import_id, position, record_id; native: scope, export_id,
    position, record_id."""
    sure = matches.filter(F.col("outcome").isin("matched", "source-matched")).select("scope", "import_id", "export_id")
    a = managed.select("scope", "import_id", "position", F.col("record_id").alias("src"))
    b = native.select("scope", "export_id", "position", F.col("record_id").alias("dst"))
    pairs = sure.join(a, ["scope", "import_id"]).join(b, ["scope", "export_id", "position"]).select("scope", "src", "dst").distinct()
    only = lambda c: pairs.groupBy("scope", c).count().filter("count = 1").select("scope", c)
    kept = pairs.join(only("src"), ["scope", "src"], "left_semi").join(only("dst"), ["scope", "dst"], "left_semi")
    return kept.select("scope", "src", "dst", F.lit("struct-maps-to").alias("kind_name"), F.lit(None).cast("string").alias("payload"))


def rule_structs(matches: DataFrame, managed: DataFrame, native: DataFrame, checks: DataFrame) -> DataFrame:
    """Interop002: signatures with a pair of records whose layouts (``compare_structs``) differ, or aren't
    known to agree."""
    worst = struct_verdict(checks).filter("verdict != 'compatible'")
    sure = matches.filter(F.col("export_id").isNotNull()).select("scope", "import_id", "export_id")
    a = managed.select("scope", "import_id", "position", F.col("record_id").alias("managed_id"))
    b = native.select("scope", "export_id", "position", F.col("record_id").alias("native_id"))
    rows = sure.join(a, ["scope", "import_id"]).join(b, ["scope", "export_id", "position"]).join(worst, ["scope", "managed_id", "native_id"])
    return _finding(rows, "Interop002", F.when(F.col("verdict") == "incompatible", "error").otherwise("warning"), F.concat(F.lit("parameter "), F.col("position").cast("string"), F.lit(": "), F.col("verdict"))).distinct()


def publish_boundary(imports: DataFrame, matches: DataFrame, findings: DataFrame, structs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, edges) that record an analysis: one match per import, one annotation per
    finding, one pinvoke-maps-to edge per sure match, and the ``struct_edges`` if given.  Ids depend on
    the facts alone."""
    row = lambda rows, flavor, args: rows.select(
        "scope", F.col("import_id").alias("symbol_id"), F.lit(flavor).alias("name"), F.lit(flavor).alias("full_name"), F.lit(flavor).alias("flavor"), F.to_json(F.struct(*args)).alias("args_json"), F.lit(None).cast("long").alias("attribute_symbol_id")
    )
    rows = row(matches, FLAVORS["match"], ["outcome", "export_id", "spelling"]).unionByName(row(findings, FLAVORS["finding"], ["rule", "severity", "detail", "export_id"])).distinct()
    marks = rows.withColumn("id", F.abs(F.xxhash64("scope", "symbol_id", "flavor", "args_json") % F.lit(1 << 62)))
    edges = match_edges(imports, matches)
    return marks, edges if structs is None else edges.unionByName(structs)


def _stored(t: GraphTables, symbol: str, flavor: str) -> DataFrame:
    """Stored facts of a symbol.  ``state`` is 'stored', 'unreadable' (the facts can't be read) or
    'not-analyzed' (nothing was published about the symbol), so silence is never taken for a result."""
    few = top_match(t, symbol).select("scope", F.col("id").alias("symbol_id"))
    mine = t.annotations.filter(F.col("flavor") == flavor).select("scope", "id", "symbol_id", "args_json")
    names = located(t).select("scope", F.col("id").alias("symbol_id"), "fqn", "path")
    facts = F.from_json("args_json", "map<string,string>")
    rows = few.join(mine, ["scope", "symbol_id"], "left").join(names, ["scope", "symbol_id"], "left")
    state = F.when(F.col("id").isNull(), "not-analyzed").when(facts.isNull() | (F.size(facts) == 0), "unreadable").otherwise("stored")
    return rows.select("scope", "id", "symbol_id", "fqn", "path", facts.alias("facts"), state.alias("state"))


def stored_matches(t: GraphTables, symbol: str) -> DataFrame:
    """Stored match of a symbol; a row whose facts can't be read has null facts, never a guess."""
    return _stored(t, symbol, FLAVORS["match"])


def stored_findings(t: GraphTables, symbol: str) -> DataFrame:
    """Stored findings of a symbol.  One whose match was published and has none is 'stored' without
    findings: no row; one that wasn't analysed is one row that says so."""
    rows = _stored(t, symbol, FLAVORS["finding"])
    matched = stored_matches(t, symbol).filter("state = 'stored'").select("scope", "symbol_id").distinct().withColumn("_matched", F.lit(True))
    return rows.join(matched, ["scope", "symbol_id"], "left").filter("state != 'not-analyzed' or _matched is null").drop("_matched")


def compare_stored(t: GraphTables, managed: DataFrame, native: DataFrame) -> DataFrame:
    """``compare_structs`` of the layouts that are stored for two symbols (scope, id).  A layout that is
    missing or unreadable leaves one check 'layout', unknown."""
    read = t.annotations.filter(F.col("flavor") == RECORD_FLAVOR).select("scope", F.col("symbol_id").alias("id"), F.from_json("args_json", RECORD).alias("r"))
    side = lambda few: few.select("scope", "id").join(read, ["scope", "id"], "left").select(F.lit("all").alias("scope"), F.col("id").alias("record_id"), F.lit(0).alias("pair_id"), "r.*")
    a, b = side(managed), side(native)
    checks = compare_structs(a.filter("fields is not null"), b.filter("fields is not null"))
    here = a.select("scope", "pair_id", F.col("record_id").alias("managed_id"), F.col("fields").isNull().alias("_a"))
    ids = here.join(b.select("scope", "pair_id", F.col("record_id").alias("native_id"), F.col("fields").isNull().alias("_b")), ["scope", "pair_id"])
    unknown = ids.filter("_a or _b").select(F.lit("all").alias("scope"), "managed_id", "native_id", F.lit("layout").alias("aspect"), F.lit(None).cast("int").alias("ordinal"), F.lit("unknown").alias("status"))
    return checks.unionByName(unknown)
