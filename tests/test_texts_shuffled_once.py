"""Structure-aware chunking shuffles texts once and gives what its operators give one after another."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import FOOTNOTE_REF, REPEAL_NOTE, is_repealed, strip, word_count
from millrace.operators import chunking as C
from tests.compare import plain

FILL = "Bu cümle yedi söz ile burada durur. "


def document(rng, number=None):
    """A text of chapters, numbered headings of odd order, paragraphs, notes and odd blanks."""
    out = [rng.choice(["", "Giriş sözü.\n", "BİRİNCİ BÖLÜM\n", " \n"])]
    for i in range(rng.choice([0, 1, 2, 5, 12])):
        if rng.random() < 0.3:
            out.append(rng.choice(["İKİNCİ  BÖLÜM\n", "üçüncü\tbölüm\n", "xONUNCU\nBÖLÜMBEŞİNCİ BÖLÜM\n", "BÖLÜM BÖLÜM\n"]))
        head = rng.choice([f"1.{i}", "1.1", "1.1.1", "1.1.1.A", "1.1.1.A-2", "2.3", "2.3-1"]) if number is None else f"{number}.{i}"
        out.append(f"{head}{rng.choice([' ', ' - ', ' – '])}Başlık {rng.randrange(9)} {rng.choice(['', '(Ek:x) (3)', 'uzun ' * 20])}\n")
        body = rng.choice(["", "İki söz.", FILL * 3, FILL * 12, FILL * 60, "(1) " + FILL * 30 + "\n(2) " + FILL * 90, "(Mülga:RG-1)", FILL + "(12)\n(13) x (Değişik:RG) (4)  y"])
        out.append(f"{body}{rng.choice(['', chr(0xA0), chr(0x2028) + ' '])}\n")
    return "".join(out)


def one_after_another(docs, most, threshold, least, preserve_all, merge_small, include_context, legacy):
    sections = C.split_sections(docs)
    units = C.merge_small_sections(sections, most, threshold) if merge_small else sections.withColumn("is_merged", F.lit(False)).withColumn(
        "merged_sections", F.array().cast("array<string>")
    )
    if legacy:
        units = units.withColumn("char_start", F.when(F.col("is_merged"), 0).otherwise(F.col("char_start")))
    units = C.chapter_as_of(units.where(~is_repealed(F.col("content"))), C.chapters(docs))
    titles = sections.select("doc_id", "section_number", "section_title")
    done = C.finalize_chunks(C.chunk_sections(C.with_context_header(units, titles, include_context), most), None if preserve_all else least)
    return done.unionByName(C.no_heading_fallback(docs, sections), allowMissingColumns=True)


def rows_of(frame, without=()):
    columns = sorted(set(frame.columns) - set(without))
    return Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())


@pytest.mark.parametrize(
    "options",
    [
        (350, 75, 100, True, True, True, False),
        (60, 20, 30, False, True, True, True),
        (120, 75, 100, True, False, True, False),
        (350, 75, 100, True, True, False, False),
    ],
)
def test_whole_documents_equal_the_operators(spark, options):
    rng = random.Random(7)
    alone = [(i, document(rng)) for i in range(60)]
    repeated = [(100 + i, document(rng)) for i in range(8)] * 2 + [(200, None), (200, "Düz metin."), (201, None), (202, "")]
    other = [(300 + i, document(rng, number)) for i in range(6) for number in (3, 4)] + [(300, "Başlıksız.")]  # one id, several texts
    nameless = [(None, document(rng, number)) for number in (5, 6)] + [(None, "Adsız.")]
    schema = "doc_id long, text string"
    for rows, without in ((alone + repeated, ()), (other + nameless, ("chunk_order",))):  # places of equal rank are free
        docs = spark.createDataFrame(rows, schema).localCheckpoint()
        got = C.structure_chunk_documents(docs, *options).localCheckpoint()
        assert rows_of(got, without) == rows_of(one_after_another(docs, *options), without)
        headed = got.where("section_title != 'Document'").groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("chunk_order")).alias("o"))
        assert all(r.o == list(range(r.n)) for r in headed.collect())


def test_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(C, "written", None, raising=False)  # and no sections are written
    docs = spark.createDataFrame([(i, document(random.Random(i))) for i in range(40)], "doc_id long, text string")
    chunks = C.structure_chunk_documents(docs)
    assert chunks.collect()
    plan = chunks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [line for line in plan.splitlines() if " Exchange " in line and "ReusedExchange" not in line]
    assert len(made) == 1


def test_chapters_are_all_matches(spark):
    names = ["BİRİNCİ", "ikinci", "ÜçÜncÜ", "DÖRDÜNCÜ", "beşıncı", "ALTINCI", "SEKİZİNCİ", "DOKUZUNCU", "onuncu"]
    rng = random.Random(3)
    parts = [*names, "BÖLÜM", "bölüm", " ", "\n", "\t ", "\u00a0", "x", "İNCİ", "BÖLÜ", "M", "𝔸", "\r\n"]
    texts = [None, "", "BÖLÜM", " BÖLÜM", "BİRİNCİ BÖLÜM", *["".join(rng.choices(parts, k=rng.choice([2, 3, 8, 40]))) for _ in range(3000)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    heads, pieces = F.regexp_extract_all("text", F.lit(C.CHAPTER), F.lit(0)), F.split("text", C.CHAPTER, -1)
    want = {}
    for r in docs.select("doc_id", heads.alias("h"), pieces.alias("p")).where("text IS NOT NULL").collect():
        at = 0
        for head, piece in zip(r.h, r.p, strict=False):
            want.setdefault(r.doc_id, []).append((at + len(piece), head))
            at += len(piece) + len(head)
    got = {}
    for r in C.chapters(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.chapter))
    assert len(want) > 200 and got == want


def test_strip_takes_all_white_space(spark):
    texts = spark.createDataFrame([(f"{chr(i)}a {chr(i)}b{chr(i)}\n",) for i in range(70_000) if not 0xD800 <= i < 0xE000], "text string")
    plain_strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    assert texts.where(~strip(F.col("text")).eqNullSafe(plain_strip)).count() == 0
    odd = spark.createDataFrame([(None,), ("",), (" \u2003\n",), ("\ufeffa",), ("𝔸 ",)], "text string")
    assert odd.where(~strip(F.col("text")).eqNullSafe(plain_strip)).count() == 0


def test_repealed_is_fewer_than_five_words(spark):
    rng = random.Random(5)
    parts = ["a", "bc", " ", "\n", "\u00a0", "(Mülga:RG-1) (12)", "(Mülga", ")", "(Mülga:x)", "\u200b", "söz "]
    texts = [None, "", *["".join(rng.choices(parts, k=rng.randrange(1, 20))) for _ in range(3000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    want = word_count(F.regexp_replace("text", REPEAL_NOTE, "")) < 5
    assert rows.where(~is_repealed(F.col("text")).eqNullSafe(want)).count() == 0
    assert 100 < rows.where(is_repealed(F.col("text"))).count() < 2900


@pytest.mark.parametrize("text", ["(12)a(123) (1)", "x(12)", "\n(12) b", "\n (12)", "(12)", "\r(12)", "((12)"])
def test_footnotes_that_start_a_line_stay(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_replace("t", FOOTNOTE_REF, ""), F.regexp_replace("t", r"(?<!\n)\([0-9]{2,3}\)", "")).first()
    assert row[0] == row[1]
