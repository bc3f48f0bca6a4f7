"""Language-model operators: exactness, brute force, held-out accuracy, nulls, ties, repeats, empty tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import docpairs, doctext, neighbours, packing, prose, quality, tokens

DOC = "doc_id long, text string, lang string, source string, ids string"


PIECES = st.sampled_from(["the ", "Lock", " ", "  ", "\n", "\r\n", "\t", "it's", "'ll", "'", "é", "ß ", "Дом ", "字", "\u00a0", "\u3000", "\u2003 ", "12", "...", "<|endoftext|>", "🙂", "a" * 70, "x_y", "\x1f", "\x85", " (", " \x7f"])
TEXTS = st.lists(PIECES, max_size=40).map("".join)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.one_of(st.none(), TEXTS, st.text(max_size=60).filter(lambda t: t.isprintable())), max_size=6), keep=st.integers(0, 3))
def test_chunks_encode_as_whole_texts(texts, keep):
    plain = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    whole, offsets = tokens.text_bytes(pa.array(texts, pa.string()))
    starts = [*tokens.chunk_starts(whole, offsets, 8, 4), len(whole)]
    chunks = [whole[a:z] for a, z in zip(starts, starts[1:])]
    assert b"".join(chunks) == whole and all(c.decode() for c in chunks)
    shared = {c: np.array(plain(c.decode()), np.int32).tobytes() for k, c in enumerate(chunks) if k % 4 <= keep}  # a quarter of the chunks up to all
    ids, ends = tokens.ChunkEncoder(tokens.TOKENIZER, shared, 8, 4).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain(text or "")


@settings(max_examples=150, deadline=None)
@given(text=TEXTS, cuts=st.lists(st.integers(0, 200), max_size=8))
def test_joins_are_repaired_wherever_a_text_is_cut(text, cuts):
    plain = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    places = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    joiner = tokens.Joiner(tokens.TOKENIZER)
    for a, z in zip(places, places[1:]):
        joiner.add(text[a:z].encode(), plain(text[a:z]))
    assert joiner.finish() == plain(text)


def test_bytes_that_are_no_text_are_replaced():
    plain = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    rows = [b"the lock \xff\xfe keeps " * 30, b"the lock keeps " * 30, b"\xff"]
    texts = pa.StringArray.from_buffers(3, pa.py_buffer(np.cumsum([0, *map(len, rows)]).astype(np.int32).tobytes()), pa.py_buffer(b"".join(rows)))
    whole, offsets = tokens.text_bytes(texts)
    starts = [*tokens.chunk_starts(whole, offsets, 8, 4), len(whole)]
    shared = {c: np.array(plain(c.decode("utf-8", "replace")), np.int32).tobytes() for c in (whole[a:z] for a, z in zip(starts, starts[1:]))}
    for encoder in (tokens.ChunkEncoder(tokens.TOKENIZER), tokens.ChunkEncoder(tokens.TOKENIZER, dict(list(shared.items())[::2]), 8, 4)):
        ids, ends = encoder.encode(texts)
        assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [plain(r.decode("utf-8", "replace")) for r in rows]
        assert encoder.lengths(texts) == [len(plain(r.decode("utf-8", "replace"))) for r in rows]


def test_chunks_meet_again_after_other_text():
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice(["lease ", "cache ", "of ", "the ", "reader ", "keeps ", "older "]) + str(rng.randrange(999)) for _ in range(n))
    passage = words(900)
    chunks = []
    for text in (words(50) + passage, words(73) + passage + words(20)):
        whole, offsets = tokens.text_bytes(pa.array([text]))
        starts = [*tokens.chunk_starts(whole, offsets), len(whole)]
        chunks.append({whole[a:z] for a, z in zip(starts, starts[1:])})
        assert min(z - a for a, z in zip(starts, starts[1:-1])) >= tokens.LEAST_BYTES
    assert sum(map(len, chunks[0] & chunks[1])) > 0.8 * len(passage)


def test_shared_chunks_are_encoded_once(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("lease cache reader keeps older copy it's DON'T 12 (x) Дом\n".split(" ")) + str(rng.randrange(999)) for _ in range(n))
    passages = [words(400) for _ in range(3)]
    texts = [words(rng.randrange(60)) + rng.choice(passages) + words(rng.randrange(60)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, None, None, "") for k, t in enumerate(texts)], DOC).repartition(5)
    plain = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    for most in (tokens.DICTIONARY_BYTES, 2_000, 0):  # the dictionary's bound changes no id
        assert {r.doc_id: r.ids for r in tokens.encode_documents(docs, most_bytes=most).collect()} == {k: plain(t) for k, t in enumerate(texts)}
        assert sum(map(len, tokens.build_dictionary(docs, most_bytes=most))) <= most
    report = tokens.reuse_report(docs).first()
    assert report.corpus_bytes == sum(len(t.encode()) for t in texts) and report.encoded_bytes + report.dictionary_bytes < 0.6 * report.corpus_bytes and report.joins > 60
    assert tokens.reuse_report(docs.limit(0)).first().corpus_bytes == 0


def test_documents_encode(spark):
    rows = [(1, None, "en", None, "x"), (2, "", "en", None, "x"), (3, "  \n", "en", None, "x"), (4, "the lock " * 30_000, "en", None, "x"), (4, "the lock", "en", None, "x"), (None, "<|endoftext|>", "en", None, "x")]
    got = sorted(((r.doc_id or 0, len(r.ids)) for r in tokens.encode_documents(spark.createDataFrame(rows, DOC)).collect()))
    plain = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    assert got == sorted((i or 0, len(plain(t or ""))) for i, t, *_ in rows)
    assert tokens.encode_documents(spark.createDataFrame([], DOC)).count() == 0


def check_packing(rows, sizes, capacity):
    by, filled = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
    assert set(by) == {d for d, n in sizes.items() if n}
    for d, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert sum(r.n_tokens for r in pieces) == sizes[d] and len(pieces) == -(-sizes[d] // capacity) == pieces[0].n_pieces
        assert [r.first_token for r in pieces] == [k * capacity for k in range(len(pieces))]
    assert max(filled.values()) <= capacity
    return sum(filled.values()) / (len(filled) * capacity)


def test_packing_fills_containers(spark):
    rng = random.Random(4)
    sizes = {k: rng.choice([0, 1, 40, rng.randrange(1, 900), rng.randrange(2000, 9000) if k % 50 == 0 else 100]) for k in range(6000)}
    items = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int").repartition(9)
    packed = packing.pack_sizes(items, 2048, 16)
    assert check_packing(packed.collect(), sizes, 2048) > 0.98
    assert {r.doc_id for r in packing.split_documents(packed).collect()} == {d for d, n in sizes.items() if n > 2048}


def test_leftovers_are_merged_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    sizes = {k: 30 + k % 7 for k in range(400)}
    items = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int").repartition(12)
    assert check_packing(packing.pack_sizes(items, 1000, 4).collect(), sizes, 1000) > 0.9


def test_packing_of_documents(spark):
    rows = [(1, None, None, None, ""), (2, "", None, None, ""), (3, "lock", None, None, ""), (3, "lock", None, None, ""), (4, "a b " * 3000, None, None, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r.doc_id for r in got) == [3, 3, 4, 4, 4]
    assert packing.pack_documents(spark.createDataFrame([], DOC)).count() == 0
    assert packing.fill_report(packing.pack_documents(spark.createDataFrame([], DOC))).count() == 1


@pytest.mark.parametrize("comment, state", [
    (None, "none"), ("", "none"), ("&#160;", "none"), ("/// <summary></summary>", "none"), ("/** TODO: somebody please document this */", "none"), ("<inheritdoc/>", "inherits"), ('<inheritdoc cref="M:A.B"/>', "inherits"),
    ("{@inheritDoc}", "inherits"), ('<include file="d.xml" path="x"/>', "none"), ("<summary>Sorts the ledger.</summary><returns>A sorted copy without repeated rows.</returns>", "none"), ("Sort ledger", "none"),
    ("/** Sorting of ledgers. */", "none"), ("This method is used to sort the ledger.", "none"), ("SortLedger(limit)", "none"), ("Generated by the contract compiler 3.1.", "none"), ("Auto-generated, do not edit.", "none"),
    ("Author: J. Doe, 2021-03-04", "none"), ("No documentation available yet.", "none"), ("Documentation pending.", "none"), ("blah blah", "none"), ("@todo describe", "none"), ("/// @param limit the largest number of rows that may be handled", "none"),
    ("<inheritdoc/> <remarks>Blocks until the lock is free.</remarks>", "own"), ("/// <summary>\n/// Sorts the ledger and drops\n/// repeated rows.\n/// </summary>", "own"), ("/*! \\brief Throws if the lock is taken. */", "own"),
    ("Sortiert nach Pfad und Zeile.", "own"), ("  NEVER CALL THIS WHILE HOLDING A LOCK.\r\n", "own"), ("Removes all rows that were generated by an older run.", "own"), ("Never returns &lt;null&gt; &amp; never blocks.", "own"),
])
def test_documentation_is_judged(comment, state):
    assert doctext.judge(comment, "SortLedger", "App.Ledger.SortLedger", "csharp:M:App.Ledger.SortLedger(int)", "void SortLedger(int limit)", "method")[0] == state


def test_inherited_documentation(spark):
    shape = "scope_id string, id long, canonical_key string, name string, fqn string, kind_name string, file_id long, signature string, container_id long, xml_summary string, added_at timestamp_ntz, deleted_at timestamp_ntz, state string, base string"
    import datetime as dt

    now = dt.datetime(2025, 1, 1)
    sym = lambda i, name, box, doc, sig="void f()", kind=" Method", dead=None: ("s", i, f"csharp:M:T{box}.{name}", name, f"T{box}.{name}", kind, 1, sig, box, doc, now, dead, "x", "y")
    good = "Waits until the lease expires."
    rows = [
        sym(11, "Run", 1, good), sym(12, "Run", 2, "<inheritdoc/>"), sym(13, "Run", 3, "{@inheritDoc}"), sym(21, "Stop", 1, ""), sym(22, "Stop", 2, "<inheritdoc/>"), sym(31, "Spin", 4, "<inheritdoc/>"), sym(32, "Spin", 5, "<inheritdoc/>"),
        sym(41, "Own", 1, good, None), sym(42, "Own", 2, good, "  "), sym(47, "Own", 2, good, "\n\t"), sym(43, "Named", 9, '<inheritdoc cref="M:T1.Run"/>'), sym(44, "Dead", 1, good, dead=now), sym(45, "Prop", 1, good, kind="property"), sym(46, "Two", 1, "TODO"), sym(46, "Two", 1, good),
    ]
    edges = [("s", 2, 1, "Inherits", None), ("s", 2, 1, "inherits", "{}"), ("s", 3, 2, "inherits ", None), ("s", 4, 5, "inherits", None), ("s", 5, 4, "inherits", None), ("s", None, 1, None, None)]
    symbols, links = spark.createDataFrame(rows, shape), spark.createDataFrame(edges, "scope_id string, src long, dst long, kind_name string, payload string")
    got = {r.id: (r.source, r.documented_by, r.documentation) for r in docpairs.pair_documentation(symbols, links).collect()}
    assert got == {11: ("own", 11, good), 46: ("own", 46, good), 12: ("inherited", 11, good), 13: ("inherited", 11, good), 43: ("inherited", 11, good)}
    assert {r.id for r in docpairs.find_documented(symbols, links).collect()} == {11, 46}
    assert docpairs.find_documented(symbols.limit(0), links).count() == 0 and docpairs.find_documented(symbols, links.limit(0)).count() == 2


FUNCTION = "scope_id string, id long, canonical_key string, name string, fqn string, kind_name string, file_id long, signature string, container_id long, xml_summary string, added_at timestamp_ntz, deleted_at timestamp_ntz, state string, base string"


def function(i, name, box, doc, fqn=None):
    return ("s", i, f"csharp:M:T{box}.{name}", name, fqn or f"T{box}.{name}", "method", 1, "void f()", box, doc, None, None, "x", "y")


def test_documentation_comes_from_any_documented_base(spark):
    good, better, tag = "Waits until the lease expires.", "Blocks until the peer answers.", "<inheritdoc/>"
    rows = [
        function(11, "Run", 1, None), function(12, "Run", 2, good), function(13, "Run", 3, tag),  # the least base has no text, the second has
        function(21, "Go", 1, ""), function(22, "Go", 1, good), function(23, "Go", 3, tag),  # the least overload has none
        function(31, "Far", 5, good), function(33, "Far", 3, tag),  # two types up
        function(41, "Near", 5, better), function(42, "Near", 1, good), function(43, "Near", 3, tag),  # the near one of two, though its id is greater
        function(51, "Target", 9, None, "X.T"), function(52, "Target", 9, tag, "X.T"), function(50, "Target", 10, better), function(53, "Named", 8, '<inheritdoc cref="M:X.T(int)"/>'),  # a target that inherits itself
        function(61, "One", 8, '<inheritdoc cref="M:T8.Two"/>'), function(62, "Two", 8, '<inheritdoc cref="M:T8.Three"/>'), function(63, "Three", 8, '<inheritdoc cref="M:T8.One"/>'), function(60, "Three", 7, good),  # a circle with a way out
        function(71, "Into", 8, '<inheritdoc cref="M:T8.One"/>'), function(81, "Lost", 3, tag), function(82, "Lost", 1, tag),
    ]
    edges = [("s", a, b, "inherits", None) for a, b in ((3, 1), (3, 2), (1, 5), (5, 1), (9, 10), (8, 7))]
    symbols, links = spark.createDataFrame(rows, FUNCTION), spark.createDataFrame(edges, "scope_id string, src long, dst long, kind_name string, payload string")
    got = {r.id: (r.documented_by, r.documentation) for r in docpairs.pair_documentation(symbols, links).collect() if r.source == "inherited"}
    assert got == {13: (12, good), 23: (22, good), 33: (31, good), 43: (42, good), 52: (50, better), 53: (50, better), 61: (60, good), 62: (60, good), 63: (60, good), 71: (60, good)}


def test_found_functions_are_resolved_pairs(spark, monkeypatch):
    steps = {}
    for name in ("overridden", "_levels", "_ends"):
        step = getattr(docpairs, name)
        monkeypatch.setattr(docpairs, name, lambda *a, name=name, step=step: steps.setdefault(name, step(*a)))
    good, tag = "Waits until the lease expires.", "<inheritdoc/>"
    rows = [function(1, "Run", 1, good), function(2, "Run", 2, tag), function(3, "Run", 3, tag + " Blocks until the peer answers."), function(4, "Run", 4, tag), function(5, "Stop", 1, "TODO"), function(6, "Stop", 2, tag)]
    links = spark.createDataFrame([("s", a, b, "inherits", None) for a, b in ((2, 1), (3, 1), (4, 3))], "scope_id string, src long, dst long, kind_name string, payload string")
    assert {r.id for r in docpairs.find_documented(spark.createDataFrame(rows, FUNCTION), links).collect()} == {1, 3}
    assert {(r.id, r.base) for r in steps["overridden"].collect()} == {(2, 1), (4, 3), (4, 1)}
    assert {(r.id, r.level) for r in steps["_levels"].collect()} == {(1, 0), (3, 0), (2, 1), (4, 1)}
    assert {(r.id, r.end) for r in steps["_ends"][0].collect()} == {(2, 1), (4, 3)} and steps["_ends"][1] is None


def test_documentation_from_far_above(spark):
    rows = [function(1, "Run", 1, "Waits until the lease expires.")] + [function(k, "Run", k, f'<inheritdoc cref="M:T{k - 1}.Run"/>') for k in range(2, 302)]
    rows += [function(k, "Run", k, f'<inheritdoc cref="M:T{k + 1 if k < 405 else 401}.Run"/>') for k in range(401, 406)]  # a circle without text
    links = spark.createDataFrame([], "scope_id string, src long, dst long, kind_name string, payload string")
    assert {r.id: r.documented_by for r in docpairs.pair_documentation(spark.createDataFrame(rows, FUNCTION), links).collect()} == {k: 1 for k in range(1, 302)}


def test_documentation_is_found_by_rounds_alone(spark, monkeypatch):
    monkeypatch.setattr(docpairs, "OPEN_ROWS", -1)
    rows = [function(1, "Run", 1, "Waits until the lease expires.")] + [function(k, "Run", k, f'<inheritdoc cref="M:T{k - 1}.Run"/>') for k in range(2, 8)]
    links = spark.createDataFrame([], "scope_id string, src long, dst long, kind_name string, payload string")
    assert {r.id: r.documented_by for r in docpairs.pair_documentation(spark.createDataFrame(rows, FUNCTION), links).collect()} == {k: 1 for k in range(1, 8)}


def brute_nearest(vectors, k):
    out = {}
    for a, v in vectors.items():
        best = sorted(((float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), -b) for b, w in vectors.items() if b != a), reverse=True)[:k]
        out[a] = {-b: s for s, b in best}
    return out


EMB = "symbol_id long, model_version string, embedding array<float>, content_hash binary, embedded_at timestamp_ntz, code string"
MODEL = "model_id string, dimension int, version string, is_active int"


def vector_rows(count=500, dimension=20):
    import datetime as dt

    rng = np.random.default_rng(3)
    now, old = dt.datetime(2025, 2, 1), dt.datetime(2025, 1, 1)
    base = rng.standard_normal((count, dimension)).astype(np.float32)
    for k in range(0, count, 5):
        base[k + 1] = base[k] + 0.2 * rng.standard_normal(dimension).astype(np.float32)
    vectors = {k: base[k] * (1 + k % 3) for k in range(count)}
    rows = [(k, "m/1", [float(x) for x in v], b"h", now, "c") for k, v in vectors.items()]
    rows += rows[:20] + [(k, "m/1", [1.0] * dimension, b"h", old, "c") for k in range(30)]  # copies, superseded
    rows += [(9001, "m/1", None, b"h", now, "c"), (9002, "m/1", [1.0] * 3, b"h", now, "c"), (9003, "m/1", [0.0] * dimension, b"h", now, "c"), (9004, "m/1", [float("nan")] + [1.0] * (dimension - 1), b"h", now, "c"), (9005, "m/1", [None] + [1.0] * (dimension - 1), b"h", now, "c"), (9006, "other", [1.0] * dimension, b"h", now, "c"), (None, "m/1", [1.0] * dimension, b"h", now, "c")]
    return vectors, rows


def test_similar_pairs_against_brute_force(spark):
    vectors, rows = vector_rows()
    models = spark.createDataFrame([("a", 20, "m/1", 1), ("b", 0, "empty", 0)], MODEL)
    want = {tuple(sorted((a, b))) for a, near in brute_nearest(vectors, 10).items() for b, s in near.items() if s >= 0.9}
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, EMB), models).collect()}
    assert len(want) > 50 and not got - want and len(got & want) >= 0.97 * len(want)
    assert neighbours.similar_pairs(spark.createDataFrame([], EMB), models).count() == 0


def test_nearest_recall(spark):
    vectors, rows = vector_rows()
    models = spark.createDataFrame([("a", 20, "m/1", 1)], MODEL)
    got: dict = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, EMB), models, lambda c: c % 20 == 0).collect():
        got.setdefault(r.symbol_id, set()).add(r.other_id)
    want = {a: set(n) for a, n in brute_nearest(vectors, 10).items() if a % 20 == 0}
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[a] & want[a]) for a in want) >= 0.95 * 10 * len(want)


def test_equal_vectors_are_one_class(spark):
    import datetime as dt

    now = dt.datetime(2025, 1, 1)
    rows = [(k, "m/1", [1.0, 2.0, 0.5], b"", now, "") for k in range(40)] + [(100, "m/1", [1.0, 2.0, 0.6], b"", now, ""), (200, "m/1", [-1.0, 0.0, 0.0], b"", now, "")]
    models = spark.createDataFrame([("a", 3, "m/1", 1)], MODEL)
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, EMB), models).collect()}
    want = {tuple(sorted((a, b))) for a in range(40) for b in [x for x in range(11) if x != a][:10]} | {(b, 100) for b in range(10)}
    assert got == want


def test_code_bounds_hold():
    rng = np.random.default_rng(8)
    units = rng.standard_normal((400, 60)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    turn = neighbours.rotation(60)
    assert np.allclose(turn @ turn.T, np.eye(60), atol=1e-5) and turn.shape == (60, 64)
    codes, f = neighbours.encode(units, turn)
    error = np.abs(neighbours.estimates(units @ turn, codes, f) - units @ units.T)
    np.fill_diagonal(error, 0)
    assert (error <= neighbours.bounds(f, 64)).mean() > 0.93


SENTENCES = ["The lease is kept until the last reader has gone.", "We noticed that the cache was never emptied during the night.", "If the folder is missing, the server answers from the older copy.", "nobody knows why it was called twice", "Older clients keep working."]
JUNK = ["- ledger of updates", "| a | b |", "x = 3;", "2025-01-01 10:00:00 [INF] Run took=4ms", "name: value", "at App.Core.Run(int) in Core.cs:line 3", "qJ8$k2 #x!! 9f"]


def labelled(rng, n):
    rows = []
    for k in range(n):
        good, bad = rng.randrange(1, 9), rng.randrange(0, 5)
        lines = [rng.choice(SENTENCES) for _ in range(good)] if k % 2 else [rng.choice(JUNK) for _ in range(8)]
        if not k % 2 and k % 4 == 0:
            lines += [rng.choice(SENTENCES)]
        rows.append((k, "\n".join(lines if k % 2 else lines[: 4 + bad * 2]), "prose" if k % 2 else "other"))
    return rows


def test_line_model_on_held_out_documents():
    rng = random.Random(6)
    common = frozenset("the a is of to we that it if from was and".split())
    model = prose.fit_lines([(t, x) for _, t, x in labelled(rng, 200)], common)
    table = model.table(common)
    held = labelled(random.Random(7), 300)
    right = sum((prose.text_statistics(t, model, table)[5] >= 0.5) == (x == "prose") for _, t, x in held)
    assert right >= 0.93 * len(held)
    assert prose.fit_lines([], common).weights == prose.PRIOR


def test_quality_of_documents(spark):
    rng = random.Random(9)
    docs = [(i, t, "EN" if i % 3 else None, "s", "z") for i, t, _ in labelled(rng, 120)] + [(900, None, "en", "s", "z"), (901, " \n　", "en", "s", "z"), (902, "", None, None, "z"), (903, "x", "??", None, "z"), (903, "x", "??", None, "z"), (904, "lock " * 40_000, "en", None, "z")]
    labels = [(i, x) for i, _, x in labelled(random.Random(9), 120)] + [(3, "prose"), (None, "prose"), (5, None)]
    words = spark.createDataFrame([("en", w) for w in "the a is of to we that it if from was and".split()] + [(None, "x"), ("de", None)], "lang string, word string")
    args = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, label string"), words
    rated = quality.text_quality(*args).cache()
    rows = {r.doc_id: r for r in rated.collect()}
    assert set(rows) == {*range(120), 903, 904} and rated.count() == 123
    assert rows[1].language == "en" and rows[903].language == "und" and rows[904].n_words == 40_000
    assert all(0 <= r.pct_n_words <= 1 for r in rows.values())
    found = {r.doc_id for r in quality.find_unnatural(rated).collect()}
    assert {903, 904} <= found and len(found & set(range(0, 120, 2))) >= 55 and len(found & set(range(1, 120, 2))) <= 4
    empty = [a.limit(0) for a in args]
    assert quality.text_quality(*empty).count() == 0 and quality.text_quality(args[0], empty[1], empty[2]).count() == 123


def test_tails_and_percentiles(spark):
    # a tenth of the texts is junk of one value; half of punctuated_share stands at each end; n_words is 1 to 1000
    rows = [(k, "en", k, 4.0 + k % 7 / 10, 1.0 if k % 10 == 0 else 0.1 + k % 5 / 100, float(k % 2), 0.5, 0.5) for k in range(1, 1001)] + [(2000, "fr", 5, 4.0, 0.1, 0.5, 0.5, 0.5)]
    stats = spark.createDataFrame(rows, quality._SCHEMA)
    rated = {r.doc_id: r for r in quality.rate(stats, quality.sketch(stats), 2).collect()}
    flagged = {s: {i for i, r in rated.items() if s in r.tails} for s in quality.STATS}
    assert flagged["symbol_share"] == {k for k in range(1, 1001) if k % 10 == 0}
    assert flagged["n_words"] == {*range(1, 11), *range(990, 1001)} and not flagged["punctuated_share"] and not rated[2000].tails
    assert all(abs(rated[k].pct_n_words - k / 1000) <= 0.002 for k in range(1, 1001))
    parts = [quality.sketch(stats.filter(f"doc_id % 2 = {k}")) for k in (0, 1)]
    names = [f"k_{x}" for x in quality.STATS]
    merged = parts[0].unionByName(parts[1]).groupBy("language").agg(*[F.kll_merge_agg_double(c).alias(c) for c in names])
    both = {r.doc_id: (r.tails, r.pct_n_words) for r in quality.rate(stats, merged, 2).collect()}
    assert both == {i: (r.tails, r.pct_n_words) for i, r in rated.items()}  # sketches of parts merge to that of the whole
    assert {(r.punctuated_share, r.pct_punctuated_share) for i, r in rated.items() if i < 2000} == {(0.0, 0.5), (1.0, 1.0)}


def test_unnatural_texts_come_from_tails(spark):
    # English is mostly prose; Spanish mostly junk, so the pooled sketch stands in; alone it has no reference
    english = [(k, "en", 100, 5.0, 0.05, 0.9, 0.4, 0.9 + k % 10 / 100 if k % 3 else 0.1) for k in range(300)]
    spanish = [(1000 + k, "es", 100, 5.0, 0.05, 0.9, 0.4, 0.95 if k % 3 == 0 else 0.2) for k in range(60)]
    want = lambda rows: {r[0] for r in rows if r[7] < 0.5}
    for rows in (english, english + spanish, spanish):
        stats = spark.createDataFrame(rows, quality._SCHEMA)
        rated = quality.rate(stats, quality.sketch(stats), 2)
        assert {r.doc_id for r in quality.find_unnatural(rated).collect()} == want(rows)
    stats = spark.createDataFrame(english, quality._SCHEMA)
    tails = {r.doc_id: r.tails for r in quality.rate(stats, quality.sketch(stats), 2).collect()}
    assert all(("sentence_share" in tails[r[0]]) >= (r[7] < 0.5) for r in english) and not tails[5]
