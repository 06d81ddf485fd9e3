"""Documents that arrive again with another text, are withdrawn, or come twice; replays, pruning and compaction."""

import hashlib

from millrace.operators.chunking import sentence_group_chunks
from millrace.streaming import documents as D

SCHEMA = "doc_id long, text string, at long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def add(spark, root, number, rows, order=None):
    batch = spark.createDataFrame(rows, SCHEMA)
    D.add_documents(batch, number, f"{root}/registry", f"{root}/chunks", sentence_group_chunks, order)


def state(spark, root):
    documents = {(r.doc_id, r.content_hash) for r in D.current_documents(spark, f"{root}/registry").collect()}
    chunks = sorted((r.doc_id, r.chunk_order, r.chunk_text) for r in D.current_chunks(spark, f"{root}/registry", f"{root}/chunks").collect())
    return documents, chunks


def test_changed_documents_leave_only_their_new_chunks(spark, tmp_path):
    root = str(tmp_path)
    add(spark, root, 0, [(1, "Old text.", 0), (2, "Same. Text.", 0), (3, "Same. Text.", 0), (4, "Gone soon", 0), (None, "nobody", 0), (5, None, 0)])
    assert state(spark, root) == (
        {(1, sha("Old text.")), (2, sha("Same. Text.")), (3, sha("Same. Text.")), (4, sha("Gone soon"))},
        [(1, 0, "Old text"), (2, 0, "Same. Text"), (4, 0, "Gone soon")],
    )
    # Changed, changed away from a shared text, withdrawn, unchanged, twice in one batch.
    add(spark, root, 1, [(1, "New text.", 1), (2, "Other", 1), (4, None, 1), (3, "Same. Text.", 1), (6, "a", 2), (6, "b", 1)], "at")
    want = (
        {(1, sha("New text.")), (2, sha("Other")), (3, sha("Same. Text.")), (6, sha("a"))},
        [(1, 0, "New text"), (2, 0, "Other"), (3, 0, "Same. Text"), (6, 0, "a")],
    )
    assert state(spark, root) == want
    # The same batch again, as after a failure, changes nothing, nor does a later one without news.
    versions = spark.read.parquet(f"{root}/registry/versions")
    before = sorted(map(tuple, versions.collect()), key=repr)
    add(spark, root, 1, [(1, "New text.", 1), (2, "Other", 1), (4, None, 1), (3, "Same. Text.", 1), (6, "a", 2), (6, "b", 1)], "at")
    add(spark, root, 2, [(1, "New text.", 2), (4, None, 2), (6, "a", 2)])
    assert sorted(map(tuple, spark.read.parquet(f"{root}/registry/versions").collect()), key=repr) == before
    assert state(spark, root) == want
    # Back to an earlier text and back from withdrawal: shown again, not chunked again.
    pieces = spark.read.parquet(f"{root}/chunks").count()
    add(spark, root, 3, [(1, "Old text.", 3), (4, "Gone soon", 3)])
    assert (1, 0, "Old text") in state(spark, root)[1] and (4, 0, "Gone soon") in state(spark, root)[1]
    assert spark.read.parquet(f"{root}/chunks").count() == pieces


def test_compaction_keeps_what_is_current(spark, tmp_path):
    root = str(tmp_path)
    add(spark, root, 0, [(i, f"text {i % 7}", 0) for i in range(40)])
    add(spark, root, 1, [(i, f"later {i}", 0) for i in range(0, 40, 7)] + [(1, None, 0)])
    D.compact(spark, f"{root}/registry", f"{root}/chunks", f"{root}/new/registry", f"{root}/new/chunks")
    assert state(spark, f"{root}/new") == state(spark, root)
    assert spark.read.parquet(f"{root}/new/chunks").count() < spark.read.parquet(f"{root}/chunks").count()
    add(spark, f"{root}/new", 0, [(2, "text 3", 0), (50, "text 3", 0)])
    assert (50, sha("text 3")) in state(spark, f"{root}/new")[0]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    root = str(tmp_path)
    add(spark, root, 0, [(i, f"text {i}", 0) for i in range(400)])
    rows = spark.createDataFrame([("0a",)], "bucket string")
    known = D.touched(D.stored(spark, f"{root}/registry/contents", D.CONTENTS), rows)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan.split("PartitionFilters")[1]
    assert {r.content_hash[:2] for r in known.collect()} <= {"0a"}
