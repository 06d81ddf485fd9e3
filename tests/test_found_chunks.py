"""The chunk that a question's words found, not the first of its document, is what later steps read."""

from millrace.plans import QUERIES


def test_later_chunk_is_hydrated_and_ranked(spark, tmp_path):
    line = "zebra quartz violin meadow copper lantern orbit thistle"
    texts = {50: " ".join(f"a{k}" for k in range(1200)) + "\n" + line, 51: "other words " * 30, 52: "plain words " * 30}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [1.0 if k == i - 50 else 0.0 for k in range(64)], 0) for i in texts]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    hits = {r.doc_id: r for r in QUERIES["d5_hydrate_found"](spark, str(tmp_path)).collect()}
    assert line in hits[50].chunk_text and hits[50].chunk_order > 0 and hits[50].by_words
    assert (hits[51].chunk_order, hits[51].by_words) == (0, False)
    first = min(QUERIES["d9_rerank_found"](spark, str(tmp_path)).collect(), key=lambda r: r.rank)
    assert line in first.sub_text and first.doc_id == 50 and first.chunk_order == hits[50].chunk_order
