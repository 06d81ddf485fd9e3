"""File sources, report lists and stream-equals-batch tests."""

import json

from pyspark.sql import functions as F

from millrace.operators.chunking import window_chunks
from millrace.sources import files
from millrace.streaming import documents, streams
from tests.conftest import SF


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.PDF", "b.html", "deep/c.txt", "d.docx"):
        (tmp_path / name).write_text(f"text of {name}\nğüş")
    rows = {r.name: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert {k: v.type for k, v in rows.items()} == {"a": "PDF", "b": "HTML", "c": "TXT"}
    asked = spark.createDataFrame([(rows["c"].path,), ("nowhere",)], "path string")
    found = files.file_metadata(files.scan_files(spark, str(tmp_path)), asked).collect()
    assert sorted(r.missing for r in found) == [False, True]
    texts = files.read_text(spark, str(tmp_path / "deep")).collect()
    assert [t.text for t in texts] == ["text of deep/c.txt\nğüş"]


def test_unknown_types_are_apart(spark):
    rows = spark.createDataFrame([(1, "TXT", "a", None), (2, "xls", "b", None), (3, None, "c", None), (4, "PDF", None, ["x", "y"])], "id long, type string, raw string, pages array<string>")
    known, rest = files.extract_text(rows)
    assert {r.id: r.text for r in known.collect()} == {1: "a", 4: "x\n\ny"}
    assert {r.id for r in rest.collect()} == {2, 3}


def test_reports(spark, tmp_path):
    (tmp_path / "run_1.json").write_text(json.dumps({"timestamp": "t1", "summary": {"mrr": 0.5}}))
    (tmp_path / "run_2.json").write_text("{broken")
    (tmp_path / "bad name!.json").write_text("{}")
    rows = files.list_reports(spark, str(tmp_path), "timestamp string, summary struct<mrr: double>").collect()
    assert [(r.file, r.corrupt) for r in rows] == [("run_2.json", True), ("run_1.json", False)]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "questions.json").write_text(json.dumps([{"id": 1, "question": "a"}, {"id": 2, "question": "b"}]))
    assert files.read_json_table(spark, str(tmp_path / "q"), "id long, question string").count() == 2
    files.write_report(spark.sql("SELECT named_struct('mrr', 0.5D) AS summary"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().summary.mrr == 0.5


def test_stream_of_documents_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    inbox, registry, chunks, checkpoint = (str(tmp_path / n) for n in ("in", "reg", "chunks", "cp"))
    docs.where("doc_id % 2 = 0").write.parquet(inbox)

    def run():
        documents.stream_new_documents(spark, inbox, "doc_id long, text string", registry, chunks, checkpoint, window_chunks).awaitTermination()

    run()
    docs.where("doc_id % 2 = 1").unionByName(docs.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)).write.mode("append").parquet(inbox)
    run()
    run()  # nothing new
    got = documents.current_contents(spark, registry)
    want = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256)).count().count()
    assert got.count() == got.select("content_hash").distinct().count() == want
    assert documents.current_documents(spark, registry).count() == docs.count() + docs.where("doc_id % 2 = 0").count()
    assert documents.current_chunks(spark, registry, chunks).count() == window_chunks(docs.join(got.select("doc_id"), "doc_id", "left_semi")).count()


def test_log_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.log_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    newest = events.agg(F.max("ts")).first()[0]
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    batch = {(r.start, r.event_type): r.n for r in streams.log_windows(events).collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    assert all(k in got for k in batch if (newest - k[0]).total_seconds() > 3600 + 600 + 60)


def test_answer_stream_equals_batch(spark, tmp_path):
    kinds = ["metadata", "confidence", "chunk", "chunk", "chunk", "citations", "done"]
    rows = []
    for r in range(40):
        count = 5 if r % 5 == 0 else 7  # every fifth request never ends
        for n in range(count):
            kind = "error" if r % 7 == 3 and n == 6 else kinds[n]
            rows.append((f"r{r}", n, f"2024-01-01 00:{r % 50:02d}:{n:02d}", kind, f"{kind}{n} "))
    events = spark.createDataFrame(rows, "request_id string, seq long, ts string, type string, data string")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    inbox = str(tmp_path / "in")
    events.write.parquet(inbox)
    later = [("zz", 0, "2024-01-02 00:00:00", "done", ""), ("r1", 99, "2024-01-02 00:00:00", "chunk", "late")]
    stream = streams.stream_answers(spark.readStream.schema(events.schema).parquet(inbox))

    def run():
        query = (
            stream.writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    last = spark.createDataFrame(later, "request_id string, seq long, ts string, type string, data string")
    last.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(inbox)
    run()
    got = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out")).where("status <> 'late'").collect()}
    batch = {r.request_id: r for r in streams.rollup_stream_events(events).collect()}
    assert set(got) - {"zz"} == set(batch)
    for name in ("answer", "metadata", "confidence", "citations", "total_ms", "tokens", "status"):
        assert {k: getattr(got[k], name) for k in batch} == {k: getattr(v, name) for k, v in batch.items()}


def test_character_references(spark):
    from millrace.sources.files import html_to_text

    pages = {
        "a &eacute; b": "a é b",
        "&#233;&#xE9;&#x1F600;": "éé😀",
        "&amp;lt; &lt;b&gt;": "&lt; <b>",
        "&amp;#39;&#39;&amp;&amp;amp;": "&#39;'&&amp;",
        "&amp;lt; &lt;&eacute;": "&lt; <é",
        "&l&amp;t; R&D &": "&l&t; R&D &",
        "&unknown; & &#0; &#xD800;": "&unknown; & &#0; &#xD800;",
        "x&nbsp;y &apos;&quot;": "x y '\"",
    }
    rows = spark.createDataFrame([*pages.items()], "html string, want string").select(html_to_text(F.col("html")).alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())


def test_upsert_takes_the_last_write(spark):
    from millrace.sources.tables import upsert_points

    points = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, label string")
    fresh = spark.createDataFrame([(2, "x", 3), (2, "z", 2), (3, "p", 1), (3, "q", 1)], "vec_id long, label string, seq long")
    got = {tuple(r) for r in upsert_points(points, fresh, order="seq").collect()}
    assert got == {(1, "a"), (2, "x"), (3, "q")}


def test_numbering_equals_a_window(spark):
    from pyspark.sql import Window

    from millrace.sources.tables import numbered

    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, "few").alias("k"))
    for keys in (["k"], []):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"))).cast("long")
        want = {tuple(r) for r in rows.withColumn("place", place).collect()}
        assert {tuple(r) for r in numbered(rows, keys, [F.desc("v")]).collect()} == want
    assert numbered(rows.limit(0), ["k"], [F.desc("v")]).count() == 0
