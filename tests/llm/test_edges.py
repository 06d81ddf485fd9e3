"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, language_id, packing, pii, quality, text_dedup, token_counts, token_files, toxicity
from millrace.llm.entry import BYTE_BPE, PIECE_BPE, WORD_BPE
from millrace.llm.piece_codec import decode_pieces, encode_pieces

LONG = " ".join(f"word{i % 997} and" for i in range(60_000))
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "one two three four five six seven"),
    (6, LONG),
    (None, "a row without an id has some words"),
    (7, "1234 !!! ???"),
]
COLUMNS = "doc_id long, text string"
# Names that the operators use themselves, or that documents have.
EXTRA = ["lang", "source", "n_chars", "row", "key", "score", "kept", "spans", "ids", "node", "bucket", "trusted", "p", "q"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_languages(docs, empty):
    model = language_id.fit_languages(docs)
    rows = language_id.identify_languages(docs, model).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows)
    assert by[4].lang_pred == "x"
    none = language_id.fit_languages(empty)
    assert {r.lang_pred for r in language_id.identify_languages(docs, none).collect()} == {"und"}
    assert language_id.identify_languages(empty, model).count() == 0


def test_languages_are_bounded(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]} text of language number {i % 8}", f"l{min(i % 8, 5)}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit_languages(docs, max_languages=1).names == ["l5"]
    assert len(language_id.fit_languages(docs, max_languages=3).names) == 3
    assert len(language_id.fit_languages(docs).names) == 6


def test_token_files(docs, empty):
    rows = token_files.token_files(docs, WORD_BPE).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.start, r.n_tokens))] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert token_files.token_files(empty, WORD_BPE).count() == 0


def test_numerals_are_no_letters(spark, docs):
    model = language_id.fit_languages(docs)
    odd = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ ①"), (3, "_ 12"), (4, "ª")], COLUMNS)
    found = {r.doc_id: r.lang_pred for r in language_id.identify_languages(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "x"}


def test_language_ties_go_to_the_first_name(spark):
    rows = [(i, "the same words in both", lang) for i in range(40) for lang in ("b", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify_languages(docs, language_id.fit_languages(docs)).collect()
    assert {r.lang_pred for r in found} == {"a"}


def test_sentences_that_no_blank_parts(spark):
    """A sentence scores by its own words, whatever stands right before its first or behind its last."""
    import numpy as np

    names = toxicity.features_of("vile")[:1]
    model = toxicity.ToxicityModel(np.array(names), np.array([12.0]), -5.0)
    texts = ["nice day.vile thing here", "nice day. vile thing here", "day!vile", "vile?day", "a\nvile\nb", "evil.ok"]
    docs = spark.createDataFrame([*enumerate(texts)], COLUMNS)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(rows[i].predicted == 1 and len(rows[i].offending) == 1 for i in range(5)) and rows[5].predicted == 0
    assert abs(rows[0].score - rows[1].score) < 1e-12
    span = rows[0].offending[0]
    assert texts[0][span.start : span.end] == "vile thing here"


def test_toxicity(docs, empty, labels):
    model = toxicity.fit_toxicity(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert [rows[i].score for i in (1, 2)] == [0.0, 0.0] and all(0 <= r.score <= 1 for r in rows.values())
    assert toxicity.score_toxicity(docs, model, carry_row=True).select("row.*").columns == docs.columns
    untrained = toxicity.fit_toxicity(empty, labels.limit(0))
    assert toxicity.score_toxicity(docs, untrained).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_quality(docs, empty, labels):
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and [by[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 0, 7]
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality.score_quality(docs, model, carry_row=True).select("row.*").columns == docs.columns
    untrained = quality.fit_quality(empty, labels.limit(0))
    assert quality.score_quality(empty, untrained).count() == 0


def test_token_counts(docs, empty):
    rows = token_counts.count_tokens(docs, BYTE_BPE).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and [by[i].n_tokens for i in (1, 2)] == [0, 0] and by[6].over_limit and not by[4].over_limit
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def test_tasks_of_one_worker_share_caches(spark, docs):
    """Functions reach workers by value: unpickled twice in one process, they must not make caches of their own."""
    import pyarrow as pa
    from pyspark import cloudpickle

    from millrace.llm import shared

    maps, cls = [], type(docs)
    kept = cls.mapInArrow
    cls.mapInArrow = lambda self, fn, schema, *a, **b: (maps.append(cloudpickle.dumps(fn)), kept(self, fn, schema, *a, **b))[1]
    try:
        token_counts.count_tokens(docs, BYTE_BPE)
        encode_pieces(docs, PIECE_BPE)
        packing.cut_pieces(docs.limit(1), WORD_BPE)
        text_dedup.text_features(docs, 5, 2, 2)
    finally:
        cls.mapInArrow = kept
    assert len(maps) == 4
    for pickled in maps:
        sizes = []
        for _ in range(3):
            batch = pa.RecordBatch.from_pydict({"key": pa.array([1, 2]), "text": ["some words", "other words"]})
            if pickled == maps[2]:
                batch = pa.RecordBatch.from_pydict({"key": [{"doc_id": 1, "row_id": 1}], "text": ["some words"]})
            list(cloudpickle.loads(pickled)(iter([batch])))
            sizes.append(len(shared._CACHES))
        assert sizes[0] == sizes[-1]


def test_bounded_caches():
    from millrace.llm.shared import BoundedCache, BoundedTable

    cache = BoundedCache(lambda w: w.upper(), megabytes=1)
    assert all(cache[f"{i}" + "x" * 5_000] == f"{i}" + "X" * 5_000 for i in range(1_000))
    assert 0 < len(cache) < 200 and cache.held <= cache.limit
    table = BoundedTable(megabytes=0.01)
    for i in range(50):
        new = {w: w for w in ("often", f"w{i}a", f"w{i}b") if w not in table}
        table.add(new, lambda: {"often", f"w{i}a", f"w{i}b"})
        assert table["often"] == "often" and table[f"w{i}a"] == f"w{i}a"
    assert len(table) < 70


def test_pieces(docs, empty):
    coded = encode_pieces(docs, PIECE_BPE)
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.decoded for r in rows}[1] == "" and {r.doc_id: r.decoded for r in rows}[6] == LONG
    again = {r.doc_id: r.decoded for r in decode_pieces(coded, PIECE_BPE).collect()}
    assert again[4] == ROWS[3][1] and again[1] == ""
    assert encode_pieces(empty, PIECE_BPE).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]
    rows = [(1, a, 1), (2, b, 1), (3, a, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [1.0, None, 0.0, 0.0], 1)]
    rows += [(9, [nan, 1.0, 0.0, 0.0], 1), (10, [inf, 1.0, 0.0, 0.0], 1), (11, [], 1), (None, a, 1), (12, [1.0], 1), (13, [2.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, kept string, node string"
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(vectors).collect()}
    assert len(out) == len(rows)
    assert [(out[i].n_links, out[i].component_id) for i in (1, 2, 3)] == [(2, 1), (2, 1), (2, 1)]
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert (out[12].n_links, out[13].component_id) == (1, 12) and out[None].kept and out[None].component_id is None
    assert embedding_dedup.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_texts(docs, empty):
    rows = text_dedup.near_duplicate_texts(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and not by[5].kept and sorted(r.kept for r in rows if r.doc_id == 4) == [False, True]
    assert all(by[i].component_id == i and by[i].kept for i in (1, 2, 3, 6, 7))
    assert by[None].kept and by[None].component_id is None
    assert text_dedup.near_duplicate_texts(empty).count() == 0
    with pytest.raises(TypeError):
        text_dedup.near_duplicate_texts(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_texts_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, b), (4, a), (4, b), (4, a), (None, a), (None, "c d e"), (None, "c d e"), (9, a + " more")]
    got = text_dedup.near_duplicate_texts(spark.createDataFrame(rows, COLUMNS).withColumn("n", F.monotonically_increasing_id()), row_col="n")
    by = {r.n: r for r in got.collect()}
    numbers = [r.n for r in spark.createDataFrame(rows, COLUMNS).withColumn("n", F.monotonically_increasing_id()).collect()]
    out = [by[n] for n in numbers]
    assert [r.component_id for r in out] == [1, 4, 1, 4, 4, None, None, 4]
    assert [r.class_id for r in out] == [1, 4, 1, 4, 4, None, None, 9]
    assert [r.kept for r in out] == [True, True, False, False, False, True, False, False]


def test_texts_of_one_shingle_set_in_different_numbers(spark):
    """The weighted bands of all variants count, so which of them stands for the class decides nothing."""
    words = [f"w{i}" for i in range(5)]
    rows = [(n, " ".join(words * n)) for n in range(2, 40)]
    got = text_dedup.near_duplicate_texts(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.class_id, r.component_id) for r in got} == {(2, 2)} and [r.doc_id for r in got if r.kept] == [2]


def test_personal_data(spark, docs, empty):
    rows = pii.with_digests(pii.find_personal_data(docs)).collect()
    assert len(rows) == len(ROWS) and {r.n_email for r in rows} == {0}
    assert pii.redact(docs).columns == docs.columns
    assert [r.text for r in pii.redact(docs).where("doc_id = 1 OR doc_id = 2").orderBy("doc_id").collect()] == [None, ""]
    assert pii.find_personal_data(empty).count() == 0
    text = "write a@b.co, or +1 (555) 010-9999; card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32 end"
    one = pii.redact(spark.createDataFrame([(1, text)], COLUMNS)).first().text
    assert one == "write [EMAIL], or [PHONE]; card [CARD], iban [IBAN] end"


def test_personal_data_in_one_text_of_very_many(spark):
    """Time and memory follow the number of matches; offsets stay right behind thousands of them."""
    many = " ".join(f"écrivez à user{i}@mail.org ou +1 555 010 {i % 10000:04d};" for i in range(20_000))
    docs = spark.createDataFrame([(1, many)], COLUMNS)
    row = pii.with_digests(pii.find_personal_data(docs)).first()
    assert (row.n_email, row.n_phone) == (20_000, 20_000)
    last = row.spans.split(",")[19_999]
    kind, start, end = last.split(":")
    assert kind == "email" and many[int(start) : int(end)] == "user19999@mail.org"
    text = pii.redact(docs).first().text
    assert text == " ".join(["écrivez à [EMAIL] ou [PHONE];"] * 20_000)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 6)
    assert [s for s, _ in long] == [4096 * i for i in range(len(long))] and all(n == 4096 for _, n in long[:-1])
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_sequences_hold_all_ids(docs):
    pieces = packing.cut_pieces(docs, WORD_BPE, capacity=64)
    places = packing.assign_sequences(pieces, 64)
    whole = packing.sequences(pieces, places).collect()
    assert sum(len(r.ids) // 4 for r in whole) == pieces.agg(F.sum("length")).first()[0]
    assert max(len(r.ids) // 4 for r in whole) <= 64
