"""Stored postings and dense cells against the direct searches: segments, skipped blocks, pruned partitions, recall."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import cells, postings, retrieval
from millrace.plans import QUERIES, stored
from tests.conftest import SF


def zipf_chunks(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 90)))) for i in range(n)]


def plain_bm25(questions, chunks, k):
    texts = {i: (t or "").split() for i, t in chunks}
    mean = sum(map(len, texts.values())) / len(texts)
    df = {}
    for words in texts.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, question in questions:
        scores = {}
        for w in set(question.split()) & df.keys():
            idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
            for i, words in texts.items():
                if f := words.count(w):
                    scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out |= {(q, i, rank, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    return [*zipf_chunks(3000, 1), (5000, ""), (5001, None), (5002, "w1 " * 400), (5003, "w1 w1"), (5004, "w1 w1")]


@pytest.fixture(scope="module")
def asked():
    return [(1, "w0 w1 w2"), (2, "w3 w300 w0"), (3, "w599 nowhere"), (4, "nowhere"), (5, ""), (6, "w1"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]


def test_stored_search_equals_plain_bm25_over_segments(spark, tmp_path, corpus, asked):
    path = str(tmp_path)
    rows = spark.createDataFrame(corpus, "chunk_id long, chunk_text string").repartition(4)
    postings.add_segment(rows.where("chunk_id < 2000"), path, 0)
    questions = spark.createDataFrame(asked, "query_id long, question string")
    first = {tuple(r) for r in postings.stored_topk(questions, path, 5).collect()}
    assert first == plain_bm25(asked, [r for r in corpus if r[0] < 2000], 5)
    postings.add_segment(rows.where("chunk_id >= 2000"), path, 1)
    postings.add_segment(rows.where("chunk_id >= 2000"), path, 1)  # again, as after a failure
    report = []
    got = {tuple(r) for r in postings.stored_topk(questions, path, 5, report=report).collect()}
    assert got == plain_bm25(asked, corpus, 5)
    postings.stored_topk(questions.where("query_id = 6"), path, 5, report=report)
    assert report[0][1] < report[0][0] and report[1][1] <= 0.3 * report[1][0]  # a frequent word alone needs few of its blocks
    assert {tuple(r) for r in postings.stored_topk(questions, path, 4000).collect()} == plain_bm25(asked, corpus, 4000)


def test_only_asked_buckets_are_read(spark, tmp_path, corpus):
    path = str(tmp_path)
    postings.add_segment(spark.createDataFrame(corpus[:500], "chunk_id long, chunk_text string"), path, 0)
    blocks = postings.stored_blocks(spark, path, [3, 9])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.bucket for r in blocks.select("bucket").distinct().collect()} <= {3, 9}


def test_empty_index_and_questions(spark, tmp_path, corpus):
    rows = spark.createDataFrame(corpus[:50], "chunk_id long, chunk_text string")
    postings.add_segment(rows.limit(0), f"{tmp_path}/a", 0)
    postings.add_segment(rows, f"{tmp_path}/b", 0)
    questions = spark.createDataFrame([(1, "w1")], "query_id long, question string")
    assert postings.stored_topk(questions.limit(0), f"{tmp_path}/b", 5).count() == 0
    assert postings.stored_topk(questions, f"{tmp_path}/a", 5).count() == 0
    postings.add_segment(rows, f"{tmp_path}/a", 1)
    both = [{tuple(r) for r in postings.stored_topk(questions, f"{tmp_path}/{x}", 5).collect()} for x in "ab"]
    assert both[0] == both[1] != set()


def test_term_counts(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in rows.select(postings.term_counts(F.col("t"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a", 1), ("b", 2)] and not got[1] and not got[2]


def test_an_index_is_built_once_for_each_state_of_a_table(spark, tmp_path):
    where = str(tmp_path)
    docs = spark.createDataFrame([(50, "one two three"), (51, "four")], "doc_id long, text string")
    docs.write.parquet(f"{where}/documents.parquet")
    first = stored.lexical_index(spark, where)
    assert stored.lexical_index(spark, where) == first
    docs.write.mode("append").parquet(f"{where}/documents.parquet")
    assert stored.lexical_index(spark, where) != first
    assert stored.stored_chunks(spark, where).count() == 4


def test_all_cells_give_the_exact_search_and_few_give_most_of_it(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [1.0] + [float("nan")] * 63), (None, [1.0] * 64), (9004, [None] * 64)]
    rows = vectors.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    path = str(tmp_path)
    cells.build_cells(rows, path, cells=16)
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = retrieval.dense_topk(queries, vectors, 10)
    assert sorted(map(tuple, cells.cells_topk(queries, path, 10, probes=16).collect())) == sorted(map(tuple, exact.collect()))
    report = []
    some = cells.cells_topk(queries.limit(3), path, 10, probes=3, block=2, report=report)
    assert some.count() == 30 and all(read <= 6 for read, _ in report)
    assert spark.read.parquet(f"{path}/vectors").count() == vectors.count()
    shares = [cells.recall(cells.cells_topk(queries, path, 10, probes=p), exact).first().recall for p in (1, 4, 16)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0
    probes = cells.calibrate(spark, path, 10, target=1.0, sample=500)
    assert cells.recall(cells.cells_topk(queries, path, 10), exact).first().recall == 1.0 and probes <= 16
    cells.build_cells(rows.limit(0), f"{path}/none")
    assert cells.calibrate(spark, f"{path}/none", 10) == 1
    assert cells.cells_topk(queries, f"{path}/none", 10).count() == 0


def test_recall_of_the_registered_search(spark):
    row = QUERIES["d1_cells_recall"](spark, SF).first()
    assert row.recall >= 0.95 and row.wanted == row.queries * 20
