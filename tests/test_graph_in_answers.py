"""Graph facts in the answer payload, and the chunks that the document stream writes."""

import json

from millrace.plans import QUERIES, ingest_queries, retrieval_queries
from tests.conftest import SF


def test_payload_has_the_facts_of_named_entities(spark, monkeypatch):
    name = spark.read.parquet(f"{SF}/customer.parquet").first().c_name
    asked = spark.createDataFrame([(0, f"where is {name} now"), (50, "where is it now")], "query_id long, question string")
    monkeypatch.setattr(retrieval_queries, "questions", lambda *_: asked)
    got = {r.query_id: json.loads(r.payload) for r in QUERIES["d19_assemble_response"](spark, SF).collect()}
    assert any(f["rels"] == ["LIVES_IN"] and f["nodes"][0] == name for f in got[0]["facts"])
    assert got[50]["facts"] == []


def test_stream_writes_structure_aware_chunks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ingest_queries, "shared_dir", lambda *_: str(tmp_path))
    assert QUERIES["i1_stream_new_documents"](spark, SF).count() > 0
    written = spark.read.parquet(str(tmp_path / "chunks"))
    assert {"section_number", "chunk_order"} <= {*written.columns} and written.count() > 0
