"""Queries on chaptered sections make the numbered documents and the sections once."""

import pytest

from millrace.plans import ORACLE_SQL, QUERIES, chunk_queries
from tests.compare import same_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", ["c8_chapter_as_of", "c11_context_header", "c12_chunk_sections"])
def test_documents_are_numbered_once(spark, duck, monkeypatch, name):
    made, plain = [], chunk_queries.numbered_documents
    monkeypatch.setattr(chunk_queries, "numbered_documents", lambda *a: made.append(a) or plain(*a))
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])
    assert len(made) == 1
