"""Quality: labels meet only the texts that may have one; the others are not shuffled."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality


@pytest.mark.parametrize("bits", [26, 15, 3])  # with 8 bits nearly every row is a likely one
def test_fifths_equal_those_of_the_plain_join(spark, bits):
    odd = spark.createDataFrame([(None, "no id"), (6, "again"), (9, None), (7, "")], "doc_id long, text string")
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('t', id) AS text").unionByName(odd)
    labels = spark.range(-30, 3000).where("id % 3 = 0").selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    sample = quality.trusted_sample(labels).withColumn("fifth", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    want = docs.join(sample, "doc_id", "left").select("fifth", "text")
    got = quality.with_fifths(docs, sample, bits)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_likely_texts_are_dealt_out(spark, tmp_path):
    spark.range(50_000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    sample = spark.range(0, 50_000, 10).selectExpr("id AS doc_id", "1L AS fifth")
    joined = quality.with_fifths(docs, sample)
    assert joined.where("fifth = 1").count() == 5000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    kept, dealt = plan.split("SortMergeJoin")
    assert "hashpartitioning" not in kept and "getbit" in dealt.split("hashpartitioning")[1]
