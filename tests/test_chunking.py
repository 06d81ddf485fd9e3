"""Golden and property tests of the structure-aware chunker, on invented regulation text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions.arrays import greedy_starts
from millrace.functions.text import word_count
from millrace.operators import chunking as C

TEXT = (
    "BİRİNCİ BÖLÜM\n1.1 Amaç\nBu tebliğ amacı anlatır. " + "Uzun bir cümle burada durur. " * 20 + "\n"
    "1.2 Kapsam (Değişik:RG-1/1/2020-1)(12)\nKısa kapsam metni burada.\n"
    "İKİNCİ BÖLÜM\n1.3 Tanımlar\n(1) " + "İlk fıkra sözleri çoktur. " * 60 + "\n(2) " + "İkinci fıkra sözleri. " * 60 + "\n"
    "1.3.1 Alt başlık\nİki söz.\n1.4 Mülga başlık\n"
)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "Başlıksız düz metin."), (3, ""), (4, None)], "doc_id long, text string")


def test_sections(docs):
    rows = C.split_sections(docs).orderBy("index").collect()
    assert [r.section_number for r in rows] == ["1.1", "1.2", "1.3", "1.3.1", "1.4"]
    assert [r.section_title for r in rows] == ["Amaç", "Kapsam", "Tanımlar", "Alt başlık", "Mülga başlık"]
    assert all(TEXT[r.char_start :].lstrip().startswith(r.section_number) for r in rows)


def test_chapters_are_as_of(docs):
    rows = C.chapter_as_of(C.split_sections(docs), C.chapters(docs)).orderBy("index").collect()
    assert [r.chapter for r in rows] == ["BİRİNCİ BÖLÜM", "BİRİNCİ BÖLÜM", "İKİNCİ BÖLÜM", "İKİNCİ BÖLÜM", "İKİNCİ BÖLÜM"]


def plain_merge(rows, most, threshold):
    """One document's sections ``(number, words, repealed)``, folded one after another; the numbers of each group."""
    out, group, total = [], [], 0
    for at, (number, words, repealed) in enumerate(rows):
        beneath = at + 1 < len(rows) and rows[at + 1][0].startswith((f"{number}.", f"{number}-"))
        dropped = repealed or (beneath and words < threshold)
        joins = total < threshold or (words < threshold and total + words <= most)
        if group and (dropped or not joins):
            out, group, total = [*out, group], [], 0
        if not dropped:
            group, total = [*group, number], total + words
    return [*out, group] if group else out


def merged(spark, documents, most=350, threshold=75):
    """{document: groups of numbers} by the operator."""
    rows = [  # fewer than five words of content count as repealed
        (d, i, number, "t", "a b" if repealed else "a b c d e f", words, 2, 0)
        for d, sections in documents.items()
        for i, (number, words, repealed) in enumerate(sections)
    ]
    schema = "doc_id long, index long, section_number string, section_title string, content string, word_count long, level long, char_start long"
    found = C.merge_small_sections(spark.createDataFrame(rows, schema), most, threshold).orderBy("doc_id", "index").collect()
    out = {d: [] for d in documents}
    for r in found:
        out[r.doc_id].append(r.merged_sections or [r.section_number])
        assert r.is_merged == (len(r.merged_sections) > 1)
    return out


def test_merge_fold(spark):
    cases = [
        ([100, 30, 40], [[0, 1, 2]]),
        ([100, 80, 90], [[0], [1], [2]]),
        ([30, 340], [[0, 1]]),
        ([60, 300, 10], [[0, 1], [2]]),  # forced over the limit, so the last one stays apart
    ]
    documents = {d: [(f"1.{i}", n, False) for i, n in enumerate(sizes)] for d, (sizes, _) in enumerate(cases)}
    got = merged(spark, documents)
    assert got == {d: [[f"1.{i}" for i in group] for group in want] for d, (_, want) in enumerate(cases)}
    assert all(got[d] == plain_merge(rows, 350, 75) for d, rows in documents.items())


def test_header_only_and_repealed_sections_vanish(spark):
    assert merged(spark, {1: [("1.1", 6, False), ("1.1.1", 90, False), ("1.2", 3, True)]}) == {1: [["1.1.1"]]}


def test_merging_by_searches_equals_a_fold(spark):
    rng = random.Random(4)
    numbers = ["1.1", "1.1.1", "1.1.1.A", "1.2", "1.2-3", "2.1"]
    documents = {
        d: [(rng.choice(numbers) if d % 2 else f"1.{i}", rng.choice([1, 5, 20, 74, 75, 76, 200, 350, 500]), rng.random() < 0.15) for i in range(rng.choice([1, 2, 3, 9, 70, 300]))]
        for d in range(60)
    }
    for most, threshold in ((350, 75), (100, 75), (60, 80), (350, 1)):
        assert merged(spark, documents, most, threshold) == {d: plain_merge(rows, most, threshold) for d, rows in documents.items()}


def plain_packing(sizes, budget):
    starts, total = [], 0
    for i, n in enumerate(sizes):
        if not starts or total + n > budget:
            starts, total = [*starts, i], 0
        total += n
    return starts


def test_packing_by_searches_equals_a_fold(spark):
    rng = random.Random(6)
    rows = [(d, [rng.choice([0, 0, 1, 7, 30, 99]) for _ in range(rng.choice([0, 1, 2, 5, 64, 65, 500]))], rng.choice([-1, 0, 1, 30, 100])) for d in range(80)]
    data = spark.createDataFrame(rows, "d int, sizes array<int>, budget int")
    got = {r.d: r.s for r in data.select("d", greedy_starts(F.col("sizes"), F.col("budget")).alias("s")).collect()}
    assert got == {d: plain_packing(sizes, budget) for d, sizes, budget in rows}


def test_time_of_packing_grows_with_the_text_not_its_square(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "ab cd. " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert C.pack_sentences(docs, 3).count() == n  # every sentence a group of its own
        return time.perf_counter() - began

    seconds(100)
    short = min(seconds(20_000) for _ in range(2))
    assert min(seconds(40_000) for _ in range(2)) < 2.6 * short + 0.5


def test_end_to_end(docs):
    rows = C.structure_chunk_documents(docs).orderBy("doc_id", "chunk_order").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.chunk_order for r in one] == list(range(len(one)))
    assert {r.chunk_type for r in one} >= {"fikra"}
    assert all(r.context_header.startswith("[BÖLÜM: ") for r in one)
    assert [r.section_title for r in rows if r.doc_id > 1] == ["Document"] * 3
    assert all(r.word_count + len(r.context_header.split()) <= 350 for r in one)


def test_packing_keeps_all_words_and_the_budget(spark):
    text = " ".join(f"w{i}" + ("." if i % 7 == 0 else "") for i in range(400))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = C.pack_sentences(docs, 20).orderBy("chunk_order").collect()
    assert " ".join(r.chunk_text for r in rows) == text
    assert all(r.word_count <= 20 for r in rows)
    chars = C.char_budget_chunks(docs, 100).orderBy("chunk_order").collect()
    assert "".join(r.chunk_text for r in chars) == text.replace(". ", ".")


def test_windows(spark):
    docs = spark.createDataFrame([(n, " ".join("x" for _ in range(n))) for n in (0, 1, 500, 501, 950, 951)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in C.window_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 1, 500: 1, 501: 2, 950: 2, 951: 3}


def test_sub_chunk_tail(spark):
    rows = spark.createDataFrame([(n, " ".join("x" for _ in range(n))) for n in (120, 121, 199, 200)], "doc_id long, chunk_text string")
    out = C.sub_chunks(rows).withColumn("n", word_count(F.col("sub_text"))).orderBy("doc_id", "sub_order").collect()
    want = [(120, 120), (121, 120), (121, 31), (199, 120), (199, 109), (200, 120), (200, 110), (200, 20)]
    assert [(r.doc_id, r.n) for r in out] == want  # the last one lies wholly inside its predecessor


def test_letter_items(spark):
    docs = spark.createDataFrame([(1, "a) bir\nb) iki\n a) üç\nx a) değil")], "doc_id long, text string")
    assert {(r.letter, r.n) for r in C.letter_items(docs).collect()} == {("a", 2), ("b", 1)}
