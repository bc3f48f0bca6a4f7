"""Read-only ad-hoc SQL over the curated views."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import collect_bounded
from codeloom.tables import GraphTables
from codeloom.views import VIEW_VERSION, VIEWS, catalog, register_views

TIMEOUT_S = 5.0
ROW_CAP = 5_000
#: Scopes of a registry, and kinds of a vocabulary; more are an error.
MOST_SCOPES, MOST_NAMES = 100_000, 10_000


class QueryError(ValueError):
    """``code`` is one of no_scopes, unknown_scope, read_only, multi_statement, timeout, sql."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def tokens(sql: str):
    """(kind, text) of a statement: 'word', 'param' (@name), 'text' (literals, quoted names),
    'comment', 'space', 'end' (a semicolon) and 'other'."""
    pattern = re.compile(
        r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z))|(?P<param>@[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<space>\s+)|(?P<end>;)|(?P<other>.)", re.S
    )
    for m in pattern.finditer(sql):
        yield m.lastgroup, m[0]


def check_statement(sql: str) -> None:
    """One SELECT or WITH; a trailing semicolon and comments are fine."""
    parts = [(k, x) for k, x in tokens(sql) if k not in ("comment", "space")]
    if not parts or parts[0][0] != "word" or parts[0][1].upper() not in ("SELECT", "WITH"):
        raise QueryError("read_only", "only SELECT and WITH are allowed")
    if any(k == "end" for k, _ in parts[: max((i for i, (k, _) in enumerate(parts) if k != "end"), default=0)]):
        raise QueryError("multi_statement", "only one statement is allowed")
    depth_words = {x.upper() for k, x in parts if k == "word"}
    if depth_words & {"INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "MERGE"} and parts[0][1].upper() == "WITH" and re.search(r"\)\s*(INSERT|UPDATE|DELETE|MERGE)\b", sql, re.I):
        raise QueryError("read_only", "only SELECT and WITH are allowed")


def translate(sql: str) -> str:
    """The statement in Spark's dialect: @name to :name, case folding collations, JSON and time
    functions, outside literals and comments."""
    out = []
    for kind, text in tokens(sql):
        if kind == "param":
            out.append(":" + text[1:])
        elif kind == "end" or kind == "comment":
            out.append(" ")
        elif kind == "word" and text.lower() == "json_extract":
            out.append("get_json_object")
        else:
            out.append(text)
    done = re.sub(r"(\S+)\s+COLLATE\s+NOCASE", r"\1 COLLATE UTF8_LCASE", "".join(out), flags=re.I)
    done = re.sub(r"\bdatetime\s*\(\s*([^,()]+?)\s*,\s*'unixepoch'\s*\)", r"date_format(timestamp_seconds(\1), 'yyyy-MM-dd HH:mm:ss')", done, flags=re.I)
    shift = r"\bstrftime\s*\(\s*'%s'\s*,\s*'now'\s*,\s*'([+-]?\d+)\s+(second|minute|hour|day|month|year)s?'\s*\)"
    done = re.sub(shift, lambda m: f"unix_timestamp(current_timestamp() + INTERVAL '{int(m[1])}' {m[2].upper()})", done, flags=re.I)
    return re.sub(r"\bstrftime\s*\(\s*'%s'\s*,\s*'now'\s*\)", "unix_timestamp()", done, flags=re.I).strip()


def resolve_scopes(t: GraphTables, scope: str | None = "*", default: str | None = None) -> list[str]:
    """Scope ids of a request: '*' (all that aren't isolated), None (the default, or the only one),
    or a comma-separated list, which may name isolated ones.  The registry is one row per scope."""
    known = {r["id"]: r["isolated"] for r in collect_bounded(t.scopes.select("id", "isolated"), MOST_SCOPES)}
    if not known:
        raise QueryError("no_scopes", "no scope is registered")
    if scope is None:
        if default is None and len(known) > 1:
            raise QueryError("unknown_scope", "name a scope")
        scope = default or next(iter(known))
    wanted = list(dict.fromkeys(s.strip() for s in scope.split(",") if s.strip()))
    if wanted == ["*"]:
        if not (open_ones := sorted(k for k, isolated in known.items() if not isolated)):
            raise QueryError("no_scopes", "every registered scope is isolated; name one")
        return open_ones
    if "*" in wanted or not wanted:
        raise QueryError("unknown_scope", "'*' stands alone")
    if unknown := [s for s in wanted if s not in known]:
        raise QueryError("unknown_scope", f"unknown scope: {', '.join(unknown)}")
    return wanted


@dataclass
class QueryResult:
    columns: list[tuple[str, str]]
    rows: list[tuple]
    truncated: bool
    scopes: list[str] = field(default_factory=list)


def plan_query(spark: SparkSession, t: GraphTables, sql: str, parameters: dict | None = None, scope: str | None = "*") -> DataFrame:
    """The lazy result of a checked statement over the views of the scopes."""
    check_statement(sql)
    scopes = resolve_scopes(t, scope)
    session = spark.newSession()  # the views are seen by this statement alone
    session.conf.set("spark.sql.ansi.enabled", "false")
    views = t.restrict(scopes)
    moved = {n: DataFrame(getattr(views, n)._jdf, session) for n in views.__dataclass_fields__}
    register_views(session, GraphTables(**{n: _rebind(session, d) for n, d in moved.items()}))
    try:
        frame = session.sql(translate(sql), args=parameters or None)
    except Exception as error:  # noqa: BLE001
        raise QueryError("sql", str(error).split("\n")[0]) from None
    return frame


def _rebind(session: SparkSession, frame: DataFrame) -> DataFrame:
    """The same logical plan in another session."""
    jvm = session._jvm
    plan = frame._jdf.queryExecution().logical()
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def query_graph(spark: SparkSession, t: GraphTables, sql: str, parameters: dict | None = None, scope: str | None = "*", row_cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> QueryResult:
    """Run a statement with a row cap and a time limit; one row more than the cap tells whether the
    result was cut."""
    frame = plan_query(spark, t, sql, parameters, scope)
    tag = f"adhoc-{uuid.uuid4().hex}"
    timed_out = threading.Event()

    def stop():
        timed_out.set()
        spark.interruptTag(tag)

    timer = threading.Timer(timeout_s, stop)
    spark.addTag(tag)
    timer.start()
    try:
        rows = frame.limit(row_cap + 1).collect()
    except Exception as error:  # noqa: BLE001
        code = "timeout" if timed_out.is_set() else "sql"
        raise QueryError(code, str(error).split("\n")[0]) from None
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return QueryResult([(f.name, f.dataType.simpleString()) for f in frame.schema], [tuple(r) for r in rows[:row_cap]], len(rows) > row_cap, resolve_scopes(t, scope))


def describe_schema(t: GraphTables) -> dict:
    """Views with their columns, the kinds in use and the version of the views."""
    columns = catalog(t).orderBy("view_name", "position").collect()
    views = {n: [(r["column_name"], r["type"]) for r in columns if r["view_name"] == n] for n in VIEWS}
    kinds = lambda rows, c: sorted(r[0] for r in collect_bounded(rows.select(c).distinct().filter(F.col(c).isNotNull()), MOST_NAMES))
    return {"version": VIEW_VERSION, "views": views, "edge_kinds": kinds(t.edges, "kind_name"), "symbol_kinds": kinds(t.symbols, "kind_name"), "flavors": kinds(t.annotations, "flavor")}


def count_rows(frame: DataFrame) -> int:
    return frame.agg(F.count("*")).first()[0]
