"""Searches store no chunk texts, and only what was found is cut and shuffled for their results."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import ORACLE_SQL, QUERIES, retrieval_queries, stored
from millrace.sources.tables import likely_in
from tests.compare import same_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", ["d5_hydrate_found", "d9_rerank_found"])
def test_hydration_stores_no_chunks(spark, duck, monkeypatch, name):
    def never(*args, **kwargs):
        raise AssertionError("chunks stored")

    for module in (stored, retrieval_queries):
        monkeypatch.setattr(module, "stored_chunks", never)
    monkeypatch.setattr(stored, "_BUILT", {})
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_one_search_for_a_response(spark, monkeypatch):
    searches, plain = [], retrieval_queries.bm25
    monkeypatch.setattr(retrieval_queries, "bm25", lambda *a: searches.append(a) or plain(*a))
    QUERIES["d19_response_fields"](spark, SF).collect()
    assert len(searches) == 1


def test_likely_rows_hold_all_keys_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("text"))
    keys = rows.where("a % 100 = 3").select("a", "b")
    found = {r.a for r in likely_in(rows, keys.union(keys), ["a", "b"]).collect()}
    assert found >= set(range(3, 20_000, 100)) and len(found) < 210
    assert likely_in(rows, keys.limit(0), ["a", "b"]).count() == 0
