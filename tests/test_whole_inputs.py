"""Queries that read whole texts and all rows."""

from millrace.plans import QUERIES


def test_marker_late_in_a_text_is_found(spark, tmp_path):
    spark.createDataFrame([(3, "word " * 40 + "[7]")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["b10_citation_markers_whole"](spark, str(tmp_path)).first().markers == "7"


def test_every_chunk_is_a_hit(spark, tmp_path):
    rows = [(4, " ".join(f"a{k}" for k in range(1300)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.hit_order, r.chunk_order) for r in QUERIES["d8_context_window_all"](spark, str(tmp_path)).collect()}
    n = 1 + max(h for h, _ in got)
    assert n >= 3 and got == {(h, c) for h in range(n) for c in range(n) if abs(h - c) <= 1}


def test_every_vector_of_the_label_is_relevant(spark, tmp_path):
    rows = [(i, [1.0, i / 1000], i % 2) for i in (50, 51, 52, 53)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["f3_average_precision_all"](spark, str(tmp_path)).first().ap == round((1 + 2 / 3) / 2, 9)
