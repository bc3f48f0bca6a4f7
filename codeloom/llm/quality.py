"""Per-document text statistics, their quantile sketches per language, percentiles, robust z-scores,
distribution tails, and the texts that aren't natural prose.

Each statistic has a KLL sketch per language.  Sketches are values that merge: partial ones of the
tasks to one per language, those of all languages to a pooled one.  A text is suspected where one of
its statistics lies in a tail of its language; only suspected texts can be called unnatural, which an
exact check of their share of running sentences then confirms.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.prose import LineModel, fit_lines, text_statistics
from codeloom.session import collect_bounded, cut

#: Labelled documents that the line model is fitted on, at most, each of up to LABEL_CHARS characters.
LABELLED = 4000
LABEL_CHARS = 100_000
#: Most frequent words that are taken to the driver; more is an error.
COMMON_WORDS = 50_000
STATS = ("n_words", "mean_word_length", "symbol_share", "punctuated_share", "common_share", "sentence_share")
CUTS = tuple(round(k / 100, 2) for k in (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 99))
#: The cuts and both ends.
POINTS = (0.0, *CUTS, 1.0)
TAIL_Z = 3.5
#: Size of a sketch: ranks are exact up to so many values and within about 0.2 % beyond.
SKETCH_K = 2048
#: A text is natural prose from this share of running sentences on (as the problem states it).
NATURAL = 0.5
_SCHEMA = "doc_id long, language string, n_words long, mean_word_length double, symbol_share double, punctuated_share double, common_share double, sentence_share double"


def common_words(table: DataFrame) -> dict[str, frozenset]:
    """Frequent words by language, lower case; rows with nulls say nothing."""
    rows = collect_bounded(table.select("lang", "word").filter("lang is not null and word is not null").distinct(), COMMON_WORDS)
    words: dict[str, set] = {}
    for r in rows:
        words.setdefault(r["lang"].strip().lower(), set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in sorted(words.items())}


def fit_model(documents: DataFrame, labels: DataFrame, common: frozenset, most: int = LABELLED) -> LineModel:
    """Fit on up to ``most`` labelled documents, chosen by a hash of their id; documents with two
    labels are left out."""
    one = labels.filter("doc_id is not null and label in ('prose', 'other')").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other_label"))
    chosen = one.filter("label = other_label").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two small columns, so this broadcast is bounded
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= LABEL_CHARS)
    sample = sorted({(r["doc_id"], r["text"], r["label"]) for r in rows.limit(4 * most).collect()}, key=lambda r: (r[0], r[1]))
    return fit_lines([(text, label) for _, text, label in sample], common)


def measure(documents: DataFrame, model: LineModel, words: dict[str, frozenset]) -> DataFrame:
    """Statistics of each text that is neither null nor blank.  The language is the one whose
    frequent words the text has most different ones of (two at least), else its declared language if
    that is known, else 'und'."""
    common = frozenset().union(*words.values()) if words else frozenset()
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_model = LineModel(weights)
        table = line_model.table(common)
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["lang"].to_pylist()):
                if text is None or not text.strip():
                    continue
                *stats, frequent = text_statistics(text, line_model, table)
                best = max(((len(frequent & w), k) for k, w in words.items()), default=(0, ""))
                declared = (lang or "").strip().lower()
                rows.append((doc_id, best[1] if best[0] >= 2 else declared if declared in words else "und", *stats))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "language", *STATS])

    return documents.select("doc_id", "text", "lang").mapInArrow(run, _SCHEMA)


def sketch(stats: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(language, k_<statistic>, ...): a mergeable quantile sketch of every statistic per language.
    Partial sketches are merged, so a language with most of the documents costs no more than another."""
    return stats.groupBy("language").agg(*[F.kll_sketch_agg_double(F.col(s).cast("double"), k).alias(f"k_{s}") for s in STATS])


def pooled(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """A row like those of ``sketch`` for all languages together, merged from their sketches alone; no
    row if there is none."""
    merged = sketches.agg(F.count("*").alias("n"), *[F.kll_merge_agg_double(f"k_{s}", k).alias(f"k_{s}") for s in STATS])
    return merged.filter("n > 0").select(F.lit(None).cast("string").alias("language"), *[f"k_{s}" for s in STATS])


def _quantiles(sketches: DataFrame, most: int) -> dict:
    """Quantiles at POINTS of each statistic by language; the pooled ones under None."""
    points = F.array(*[F.lit(c) for c in POINTS])
    every = sketches.unionByName(pooled(sketches))
    rows = collect_bounded(every.select("language", *[F.kll_sketch_get_quantile_double(f"k_{s}", points).alias(s) for s in STATS]), most + 1)
    return {r["language"]: {s: list(r[s]) for s in STATS} for r in rows}


def _reference(own: list[float], pool: list[float]) -> tuple[float | None, float | None]:
    """Median and spread of the share of running sentences among natural texts.  Junk pulls only
    downwards, so the spread is that of the upper half.  A language that is mostly junk takes the
    pooled sketch; if that is mostly junk too, there is no reference."""
    for q in (own, pool):
        middle, upper = q[POINTS.index(0.5)], q[POINTS.index(0.75)]
        if middle >= NATURAL:
            return middle, max((upper - middle) / 0.6745, 0.01 * middle)
    return None, None


def rate(stats: DataFrame, sketches: DataFrame, languages: int) -> DataFrame:
    """Percentile (share of a language's values not above the value, interpolated between the cut
    points) and robust z-score (distance from the median over the quartiles' spread) of each
    statistic, and the names of those in the tails: |z| above TAIL_Z, or a value at or beyond the 1 %
    or 99 % cut.  A cut that equals its neighbour is a value that many texts share, so only values
    beyond it are a tail.  sentence_share is in a tail as well where it is more than TAIL_Z spreads
    below the natural texts' median (see ``_reference``); without such a reference every text of the
    language is suspected.  ``natural`` is false for suspected texts whose sentence_share is below
    NATURAL.  There are at most ``languages`` sketches, so their quantiles are collected and broadcast."""
    found = _quantiles(sketches, languages)
    pool = found.pop(None, None)
    schema = T.StructType([T.StructField("language", T.StringType())] + [T.StructField(f"q_{s}", T.ArrayType(T.DoubleType())) for s in STATS] + [T.StructField(c, T.DoubleType()) for c in ("natural_median", "natural_spread")])
    rows = [(k, *[q[s] for s in STATS], *_reference(q["sentence_share"], pool["sentence_share"])) for k, q in sorted(found.items())]
    joined = stats.join(F.broadcast(stats.sparkSession.createDataFrame(rows, schema)), "language", "left")
    probabilities = F.array(*[F.lit(c) for c in POINTS])
    low_share = (F.col("sentence_share") - F.col("natural_median")) / F.col("natural_spread") < -TAIL_Z
    out, tails = [], []
    for s in STATS:
        value, q = F.col(s).cast("double"), F.col(f"q_{s}")
        at = {c: F.get(q, F.lit(k)) for k, c in enumerate(POINTS)}
        k = functools.reduce(lambda a, c: a + (c <= value).cast("int"), at.values(), F.lit(0)) - 1
        low, high, p = F.get(q, k), F.get(q, k + 1), F.get(probabilities, k)
        percentile = F.when(k < 0, 0.0).when(k >= len(POINTS) - 1, 1.0).otherwise(p + (F.get(probabilities, k + 1) - p) * (value - low) / (high - low))
        spread = F.greatest((at[0.75] - at[0.25]) / 1.349, F.lit(1e-9) + F.abs(at[0.5]) * 0.01)
        z = (value - at[0.5]) / spread
        out += [F.round(percentile, 4).alias(f"pct_{s}"), F.round(z, 4).alias(f"z_{s}")]
        outside = (value < at[0.01]) | (value > at[0.99]) | ((value == at[0.01]) & (at[0.01] < at[0.05])) | ((value == at[0.99]) & (at[0.99] > at[0.95]))
        tail = outside | (F.abs(z) > TAIL_Z)
        tails.append(F.when(tail | F.coalesce(low_share, F.lit(False)) if s == "sentence_share" else tail, F.lit(s)))
    named = F.array_compact(F.array(*tails))
    suspected = F.col("natural_median").isNull() | (F.size("tails") > 0)
    rated = joined.select("doc_id", "language", *STATS, *out, named.alias("tails"), "natural_median")
    return rated.withColumn("natural", ~(suspected & (F.col("sentence_share") < NATURAL))).drop("natural_median")


def text_quality(documents: DataFrame, labels: DataFrame, words: DataFrame, most: int = LABELLED) -> DataFrame:
    """Statistics, percentiles, z-scores, tails and ``natural`` of every document that is neither
    null nor blank (those have no statistics and no row).  A text is unnatural if it lies in a tail
    and less than half of its characters other than white space stand in running sentences.  Repeated rows stay, null doc_ids
    too; without labels the line model's prior decides."""
    by_language = common_words(words)
    common = frozenset().union(*by_language.values()) if by_language else frozenset()
    model = fit_model(documents, labels, common, most)
    stats = cut(measure(documents, model, by_language))
    return rate(stats, sketch(stats), len(by_language) + 1)


def find_unnatural(rated: DataFrame) -> DataFrame:
    return rated.filter("not natural").select("doc_id").distinct()
