"""Scoring of lists, batches of questions with failures of their own, profiles, logs, JSON lists and exact percentiles."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation, graph, retrieval
from millrace.sources import tables
from millrace.sources.json_lists import read_json_lists, write_json_lists


def overlap(questions, texts):
    if any("poison" in t for t in texts):
        raise ValueError("a model that fails on its whole batch")
    return [len(set(q.split()) & set(t.split())) / len(set(q.split())) for q, t in zip(questions, texts)]


def test_scoring_lists_scores_each_pair_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counted(questions, texts, log=log):
        if not any("poison" in t for t in texts):
            with open(log, "a") as f:
                f.write("".join(f"{q}|{t}\n" for q, t in zip(questions, texts)))
        return overlap(questions, texts)

    words = "alpha beta gamma delta".split()
    parents = [(q, r, q * 10 + r, " ".join(words[: 1 + r % 4]), 0.5) for q in (1, 2) for r in range(1, 9)]
    parents += [(1, 9, 19, "poison alpha", 0.5), (2, 9, 29, None, 0.5)]
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "none")], "query_id long, question string")
    rows = spark.createDataFrame(parents, "query_id long, rank long, chunk_id long, chunk_text string, similarity double")
    got = retrieval.rerank_sub_chunks(rows, questions, retrieval.BatchScorer(counted, 3), threshold=0.0, kept=20)
    by_column = retrieval.rerank_sub_chunks(rows.where("chunk_text NOT LIKE 'poison%'"), questions, threshold=0.0, kept=20)
    names = ["query_id", "parent_chunk_id", "sub_order", "ce_score", "rank"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, by_column.select(names).collect()))
    got.count()
    calls = open(log).read().split("\n")[:-1]
    assert len(calls) == len(set(calls)) == 4  # four texts for one wording, read by two questions and two actions


def test_a_question_fails_alone(spark):
    asked = spark.createDataFrame([(1, "find me"), (2, None), (3, " ?! "), (4, "lost")], "query_id long, question string")
    passed = []

    def retrieve(rows):
        passed.extend(r.query_id for r in rows.collect())
        return rows.select("query_id", F.when(F.col("query_id") == 1, 3).otherwise(0).alias("total_sources"))

    rows = {r.query_id: r.error for r in retrieval.batch_ask(asked, retrieve).collect()}
    assert rows == {1: None, 2: "empty question", 3: "empty question", 4: "no sources"} and sorted(passed) == [1, 4]
    assert retrieval.batch_totals(retrieval.batch_ask(asked, retrieve)).first()[:] == (4, 1, 3)


def test_profiles_have_the_properties_of_a_merged_graph(spark):
    node, edge = "name string, label string, props map<string,string>", "src string, predicate string, dst string, props map<string,string>"
    old = spark.createDataFrame([("a", "X", {"k": "1", "z": None})], node), spark.createDataFrame([("a", "P", "b", {"w": "1"})], edge)
    new = spark.createDataFrame([("a", "X", {"k": "2"}), ("b", "X", {})], node), spark.createDataFrame([("a", "P", "b", {"v": "3"}), ("b", "Q", "a", {})], edge)
    nodes, edges = graph.merge_graph(old[0], new[0], old[1], new[1])
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = {r.name: tuple(r)[1:] for r in graph.entity_profile(names, nodes, edges).collect()}
    assert got["a"] == ("X", "k=2; z=", "P b (v=3; w=1)", "Q b") and got["b"] == ("X", "", "Q a", "P a (v=3; w=1)")
    assert got["c"] == (None, None, "", "")
    empty = graph.clear_graph(nodes, edges)
    assert [e.count() for e in empty] == [0, 0] and empty[0].schema == nodes.schema


def test_a_log_batch_replaces_itself_and_a_reset_table_is_empty(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(10).select(F.col("id").alias("event_id"))
    for batch in (0, 1, 0, 1):
        tables.append_query_log(rows.where(F.col("event_id") % 2 == batch), path, batch)
    assert sorted(r.event_id for r in tables.query_log(spark, path, rows.schema).collect()) == list(range(10))
    points = spark.createDataFrame([(1, "a")], "vec_id long, label string")
    assert tables.reset(points).count() == 0 and tables.reset(points).schema == points.schema


def test_json_lists(spark, tmp_path):
    path = f"file://{tmp_path}/lists"
    rows = spark.range(20).select("id", F.concat(F.lit("söz "), F.col("id").cast("string")).alias("text"), F.array(F.lit("a")).alias("tags")).repartition(3)
    write_json_lists(rows, path)
    files = [f for f in os.listdir(tmp_path / "lists") if f.endswith(".json")]
    assert len(files) == 3 and all(isinstance(json.loads((tmp_path / "lists" / f).read_text()), list) for f in files)
    assert sorted(map(tuple, read_json_lists(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "lists" / "broken.json").write_text('[{"id": 1}')
    (tmp_path / "lists" / "one.json").write_text('{"id": 77, "more": 1}')
    (tmp_path / "lists" / "mixed.json").write_text('[{"id": 78}, 5]')
    assert read_json_lists(spark, path, "id long").count() == 22
    got = read_json_lists(spark, path, "id long, _corrupt_record string").where("_corrupt_record IS NOT NULL")
    assert sorted(r[1] for r in got.collect()) == ["5", '[{"id": 1}']
    write_json_lists(rows.limit(2), path, "overwrite")
    assert read_json_lists(spark, path, "id long").count() == 4
    assert read_json_lists(spark, f"file://{tmp_path}/nowhere", "id long").count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/lists"
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        write_json_lists(bad, path)
    assert not [f for f in os.listdir(tmp_path / "lists") if f.endswith(".json")] if (tmp_path / "lists").exists() else True


def test_order_statistics_by_ranges(spark):
    rng = random.Random(2)
    rows = [(k, v) for k in ("hot", "few", None) for v in [rng.choice([1.5, 2.0, 7.25, None, *range(300)]) for _ in range({"hot": 4000, "few": 7}.get(k, 50))]]
    data = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in [*rows, ("void", None)]], "k string, v double").repartition(6)
    got = {r.k: r for r in evaluation.latency_stats(data, "v", ["k"]).collect()}
    for key in ("hot", "few", None):
        values = sorted(float(v) for k, v in rows if k == key and v is not None)
        n = len(values)
        assert got[key].n == n and got[key].min_ms == round(values[0], 1) and got[key].max_ms == round(values[-1], 1)
        assert got[key].p95_ms == pytest.approx(values[math.ceil(0.95 * n) - 1], abs=0.051) and got[key].p99_ms == pytest.approx(values[math.ceil(0.99 * n) - 1], abs=0.051)
        assert got[key].median_ms == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2, abs=0.051)
    assert got["void"].n == 0 and got["void"].p95_ms is None
    assert evaluation.latency_stats(data.limit(0), "v").first().n == 0
