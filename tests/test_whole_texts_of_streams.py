"""Changed documents: every word of a text counts, and a text that is missing is revised like any other."""

import duckdb

from millrace.plans import ORACLE_SQL, QUERIES
from tests.compare import same_rows


def test_words_behind_numbers_and_missing_texts(spark, tmp_path):
    texts = [(1, "20.118.157.107 Betz +1 (726) 555-7857 das mit. Ende."), (2, None), (3, "(1) One.\n2.3 Two (4) three"), (4, "gone"), (5, ""), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(2, 0, 0), (3, 0, 0), (4, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "i1_stream_changed_documents"
    same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
