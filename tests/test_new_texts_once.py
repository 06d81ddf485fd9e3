"""A batch of the document stream finds what is new by hashes; only new texts are dealt out, each once."""

from pyspark.sql import functions as F

from millrace.operators.chunking import window_chunks
from millrace.streaming import documents as D
from tests.test_document_stream import sha


def test_only_new_texts_are_written_and_chunked(spark, tmp_path, monkeypatch):
    held, chunked, plain = [], [], D.written

    def noted(df, name, packed=False):
        held.append((name, "text" in df.columns))
        return plain(df, name, packed)

    def chunk(docs):
        chunked.append(sorted(map(tuple, docs.collect())))
        return window_chunks(docs)

    monkeypatch.setattr(D, "written", noted)
    batches = [[(1, "a b"), (2, "a b"), (3, "c"), (None, "x")], [(4, "a b"), (5, "d e"), (5, "d e"), (6, "d e"), (3, None)], [(7, "c")]]
    for number, rows in enumerate(batches):
        arrived = spark.createDataFrame(rows, "doc_id long, text string")
        D.add_documents(arrived, number, f"{tmp_path}/registry", f"{tmp_path}/chunks", chunk)
    assert {name for name, text in held if text} == {"fresh"}
    assert chunked == [sorted([(sha("a b"), "a b"), (sha("c"), "c")]), [(sha("d e"), "d e")], []]
    chunks = D.current_chunks(spark, f"{tmp_path}/registry", f"{tmp_path}/chunks")
    got = {(r.doc_id, r.content_hash, r.chunk_text, r.holders) for r in chunks.join(D.current_contents(spark, f"{tmp_path}/registry").select("content_hash", "holders"), "content_hash").collect()}
    assert got == {(1, sha("a b"), "a b", 3), (7, sha("c"), "c", 1), (5, sha("d e"), "d e", 2)}
    assert spark.read.parquet(f"{tmp_path}/chunks").select(F.count("*")).first()[0] == 3
