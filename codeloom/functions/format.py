"""One-line renderings of symbols, history and payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.keys import ACCESSIBILITY

#: Characters of a summary and keys of a payload that are shown (fixed values).
SUMMARY_CHARS, PAYLOAD_KEYS = 120, 5


def location(path: str = "path", line: str = "start_line", col: str = "start_col") -> Column:
    """path:line:col; null if one is missing."""
    return F.concat(F.col(path), F.lit(":"), F.col(line).cast("string"), F.lit(":"), F.col(col).cast("string"))


def accessibility_label(column: str = "accessibility") -> Column:
    """The name of an accessibility code; '' for unknown codes and null."""
    out = F.lit("")
    for name, code in ACCESSIBILITY.items():
        out = F.when(F.col(column) == code, name).otherwise(out)
    return out


def kind_with_attributes(kind: str = "kind_name", generated: Column | None = None) -> Column:
    """Accessibility, modifiers and kind in a row; '(generated)' for symbols of generated files."""
    filled = lambda c: F.when(c != "", c)
    text = F.concat_ws(" ", filled(accessibility_label()), filled(F.replace(F.coalesce("modifiers", F.lit("")), F.lit(","), F.lit(" "))), F.col(kind))
    return text if generated is None else F.concat(text, F.when(F.coalesce(generated, F.lit(False)), " (generated)").otherwise(""))


def one_line_summary(column: str = "xml_summary") -> Column:
    """The first sentence on one line, cut after SUMMARY_CHARS characters; null for blank texts."""
    flat = F.trim(F.translate(F.col(column), "\r\n", "  "))
    end = F.instr(flat, ". ")
    first = F.when(end > 0, F.substr(flat, F.lit(1), end)).otherwise(flat)
    short = F.when(F.length(first) > SUMMARY_CHARS, F.concat(F.rtrim(F.substr(first, F.lit(1), F.lit(SUMMARY_CHARS))), F.lit("…"))).otherwise(first)
    return F.when(flat != "", short)


def history_line() -> Column:
    """'last touched <day> by <author> (<short sha>)' from the columns of the history; null if neither
    commit nor author is known."""
    sha = F.coalesce(F.when(F.col("last_commit_sha") != "", F.substring("last_commit_sha", 1, 7)), F.lit("(none)"))
    day = F.coalesce(F.date_format(F.timestamp_millis("last_authored_at"), "yyyy-MM-dd"), F.lit("?"))
    known = (F.coalesce("last_commit_sha", F.lit("")) != "") | F.col("last_author").isNotNull()
    return F.when(known, F.concat(F.lit("last touched "), day, F.lit(" by "), F.coalesce("last_author", F.lit("(unknown)")), F.lit(" ("), sha, F.lit(")")))


def payload_line(column: str = "payload") -> Column:
    """'{ key: value, ... }' with the first PAYLOAD_KEYS values as JSON; null for payloads that are no
    object, empty or damaged."""
    sound = F.when(F.try_parse_json(F.col(column)).isNotNull(), F.col(column))
    entries = F.map_entries(F.from_json(sound, "map<string,variant>"))
    shown = F.transform(F.slice(entries, 1, PAYLOAD_KEYS), lambda e: F.concat(e["key"], F.lit(": "), F.to_json(e["value"])))
    more = F.when(F.size(entries) > PAYLOAD_KEYS, F.concat(F.lit(" ("), (F.size(entries) - PAYLOAD_KEYS).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(entries) > 0, F.concat(F.lit("{ "), F.concat_ws(", ", shown), more, F.lit(" }")))
