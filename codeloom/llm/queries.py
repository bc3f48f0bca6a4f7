"""Queries of the language-model problems with their SQL where SQL can express them."""

from __future__ import annotations

from codeloom.llm.docpairs import find_documented, pair_documentation
from codeloom.llm.neighbours import nearest, similar_pairs
from codeloom.llm.packing import fill_report, pack_documents, split_documents
from codeloom.llm.quality import find_unnatural, text_quality
from codeloom.llm.tokens import encode_documents
from codeloom.session import read_table


def p2_found(spark, sf_dir):
    return find_documented(read_table(spark, sf_dir, "symbols"), read_table(spark, sf_dir, "edges"))


def p2_pairs(spark, sf_dir):
    return pair_documentation(read_table(spark, sf_dir, "symbols"), read_table(spark, sf_dir, "edges"))


def p5_found(spark, sf_dir):
    return similar_pairs(read_table(spark, sf_dir, "symbol_embeddings"), read_table(spark, sf_dir, "embedding_models"))


def p5_nearest(spark, sf_dir):
    """The stated query set (symbols whose id is divisible by 20) against all rows."""
    tables = [read_table(spark, sf_dir, t) for t in ("symbol_embeddings", "embedding_models")]
    return nearest(*tables, lambda c: c % 20 == 0)


def p6_ids(spark, sf_dir):
    return encode_documents(read_table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    return split_documents(pack_documents(read_table(spark, sf_dir, "documents")))


def p7_pack(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"))


def p7_fill(spark, sf_dir):
    return fill_report(pack_documents(read_table(spark, sf_dir, "documents")))


def p8_stats(spark, sf_dir):
    return text_quality(*[read_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "common_words")])


def p8_found(spark, sf_dir):
    return find_unnatural(p8_stats(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_nearest": p5_nearest, "p6_ids": p6_ids, "p7_found": p7_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_stats": p8_stats}
#: Brute force over all pairs of one model; the other queries have no counterpart in SQL.
SQL: dict[str, str] = {
    "p5_found": """
WITH usable AS (
  SELECT e.model_version, e.symbol_id, arg_max(e.embedding, e.embedded_at)::DOUBLE[] AS v FROM symbol_embeddings e JOIN embedding_models m ON m.version = e.model_version
  WHERE e.symbol_id IS NOT NULL AND len(e.embedding) = m.dimension AND len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0
  GROUP BY e.model_version, e.symbol_id
), ranked AS (
  SELECT a, b, c, row_number() OVER (PARTITION BY model_version, a ORDER BY c DESC, b) AS nth
  FROM (SELECT x.model_version, x.symbol_id AS a, y.symbol_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM usable x JOIN usable y ON x.model_version = y.model_version AND x.symbol_id <> y.symbol_id)
)
SELECT DISTINCT least(a, b) AS symbol_id_a, greatest(a, b) AS symbol_id_b FROM ranked WHERE nth <= 10 AND c >= 0.9"""
}
