"""Fragment search over names and documentation, and the text that symbols are embedded by."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import cleaned_arguments
from codeloom.session import cut
from codeloom.tables import GraphTables, StoredTables

COLUMNS = ("name", "fqn", "signature", "xml_summary")
K1, B = 1.2, 0.75


def _folded(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _hits(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of the phrase: positions at which it starts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (len(phrase) - 1), F.lit(1)))
    return F.when(F.contains(text, F.lit(phrase)), F.size(F.filter(starts, lambda k: F.substr(text, k, F.lit(len(phrase))) == phrase))).otherwise(0)


def search_symbols(t: GraphTables, query: str, kind: str | None = None, top_k: int = 25) -> DataFrame:
    """Symbols that contain the phrase, letter case aside, in a name, signature or documentation,
    best first by the rank of trigram phrase matches (smaller is better).  Phrases of fewer than
    three characters match nothing; % and _ are ordinary characters.

    The text is read once: matching rows are written with their counts, which then give how many match.
    Number and mean length of all symbols are found once per stored model.
    """
    phrase = query.lower()
    columns = ["scope", "id", "name", "fqn", "kind_name"]
    if len(phrase) < 3:
        return t.symbols.select(*columns, F.lit(0.0).alias("score")).limit(0)
    tokens = F.lit(0)
    found = F.lit(False)
    for c in COLUMNS:
        tokens = tokens + F.greatest(F.length(_folded(c)) - 2, F.lit(0))
        found = found | F.contains(_folded(c), F.lit(phrase))
    size = lambda: tuple(t.symbols.agg(F.count("*"), F.avg(tokens)).first())
    n, mean = t.once("search_size", size) if isinstance(t, StoredTables) else size()
    f = F.lit(0)
    for c in COLUMNS:
        f = f + _hits(_folded(c), phrase)
    matching = cut(t.symbols.filter(found).select(*columns, tokens.alias("_tokens"), f.alias("_f")))
    hit = matching.count()
    idf = max(math.log((n - hit + 0.5) / (hit + 0.5)), 1e-6) if n else 1e-6
    if kind is not None:
        matching = matching.filter(F.col("kind_name") == kind)
    f = F.col("_f")
    length = K1 * ((1 - B) + B * F.col("_tokens") / F.lit(float(mean or 1.0)))
    score = F.round(-F.lit(idf) * f * (K1 + 1) / (f + length), 6)
    return matching.select(*columns, score.alias("score")).orderBy("score", "scope", "id").limit(top_k)


def search_annotations(t: GraphTables, query: str) -> DataFrame:
    """Annotations whose cleaned arguments contain the phrase, letter case aside."""
    if len(query.strip()) < 3:
        return t.annotations.limit(0)
    return t.annotations.filter(F.contains(F.lower(cleaned_arguments()), F.lit(query.strip().lower())))


def embedding_text(t: GraphTables, bodies: DataFrame | None = None) -> DataFrame:
    """(scope, symbol_id, text, content_hash) of symbols worth embedding: kind and full name, then
    documentation, signature and body, each on a line; symbols of generated files, and those with
    neither documentation nor body, are left out."""
    rows = t.symbols.join(t.files.filter("is_generated = 0").select("scope", F.col("id").alias("file_id")), ["scope", "file_id"], "left_semi")
    rows = rows.join(bodies, ["scope", "id"], "left") if bodies is not None else rows.withColumn("body", F.lit(None).cast("string"))
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c) if isinstance(c, str) else c)
    text = F.concat_ws("\n", F.concat("kind_name", F.lit(" "), "fqn"), blank(F.col("xml_summary")), blank(F.col("signature")), blank(F.col("body")))
    kept = rows.filter((F.trim(F.coalesce("xml_summary", F.lit(""))) != "") | (F.trim(F.coalesce("body", F.lit(""))) != ""))
    return kept.select("scope", F.col("id").alias("symbol_id"), text.alias("text"), F.sha2(text, 256).alias("content_hash"))
