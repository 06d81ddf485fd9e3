"""Registered queries over evaluation operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.plans import retrieval_queries as RQ
from millrace.plans.registry import query, table
from millrace.sources.scratch import written

# The lexical list of chunks is stage 1, the parents of the reranked sub-chunks are stage 2.
STAGE1_SQL = f"WITH {RQ.RANKED_SQL}, stage1 AS (SELECT query_id, chunk_id.d AS item, rank FROM bm25)"
RANKS_SQL = f"""
    {STAGE1_SQL}, r1 AS (SELECT q.query_id, coalesce(min(rank), -1) AS rank FROM questions q LEFT JOIN stage1 s ON s.query_id = q.query_id AND item = q.query_id GROUP BY 1),
    firsts AS (SELECT query_id, parent_chunk_id.d AS item, min(rank) AS f FROM ranked GROUP BY 1, 2),
    parents AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM firsts),
    r2 AS (SELECT q.query_id, coalesce(min(rank), -1) AS rank FROM questions q LEFT JOIN parents p ON p.query_id = q.query_id AND item = q.query_id GROUP BY 1)
"""
METRICS_SQL = """
    SELECT query_id, (rank BETWEEN 1 AND 1)::INT::DOUBLE AS "hit@1", (rank BETWEEN 1 AND 3)::INT::DOUBLE AS "hit@3", (rank BETWEEN 1 AND 5)::INT::DOUBLE AS "hit@5",
        (rank BETWEEN 1 AND 10)::INT::DOUBLE AS "hit@10", CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END AS mrr, CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END AS map,
        CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0::DOUBLE END AS "ndcg@5", CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0::DOUBLE END AS "ndcg@10"
"""
AVERAGES = ", ".join(f'round(avg("{m}"), 4) AS "{m}"' for m in E.METRICS)


def _with_relevant(spark, d):
    return RQ.questions(spark, d).withColumn("relevant", F.col("query_id"))


def ranks(spark, d, stage, hits=None):
    """The rank of each question's document among the chunks that words found (1) or the reranked parents (2)."""
    if stage == 1:
        hits = RQ.bm25(spark, d) if hits is None else hits
        ranked = hits.select("query_id", F.col("chunk_id.doc_id").alias("item"), "rank")
    else:
        ranked = E.dedupe_ranked_parents(parents(spark, d, hits), "item")
    return E.find_rank(_with_relevant(spark, d), ranked)


def parents(spark, d, hits=None):
    return RQ.ranked(spark, d, hits).select("query_id", F.col("parent_chunk_id.doc_id").alias("item"), "rank")


def both_stages(spark, d):
    """Average metrics of both stages over one search."""
    hits = written(RQ.bm25(spark, d), "hits")
    return [E.average_metrics(E.ir_metrics(ranks(spark, d, stage, hits))) for stage in (1, 2)]


@query("f1_hit_at_k", f"{RANKS_SQL} SELECT query_id, rank, (rank BETWEEN 1 AND 5)::INT::DOUBLE AS hit5 FROM r1")
def f1(spark, d):
    return ranks(spark, d, 1).select("query_id", "rank", E.hit_at(F.col("rank"), 5).alias("hit5"))


@query("f2_reciprocal_rank", f"{RANKS_SQL} SELECT query_id, CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END AS rr FROM r1")
def f2(spark, d):
    return ranks(spark, d, 1).select("query_id", E.reciprocal_rank(F.col("rank")).alias("rr"))


_AVERAGE_PRECISION = f"""
    WITH {RQ.DENSE_SQL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    hits AS (SELECT d.query_id, row_number() OVER (PARTITION BY d.query_id ORDER BY rank)::DOUBLE / rank AS p
        FROM dense d JOIN embeddings q ON q.vec_id = d.query_id JOIN embeddings v ON v.vec_id = d.vec_id WHERE q.label = v.label),
    s AS (SELECT query_id, sum(p) AS s FROM hits GROUP BY 1)
    SELECT vec_id AS query_id, round(coalesce(s, 0) / n, 9) AS ap FROM embeddings JOIN n USING (label) LEFT JOIN s ON query_id = vec_id WHERE vec_id % 50 = 0
    """


@query("f3_average_precision", _AVERAGE_PRECISION)
@query("f3_average_precision_all", _AVERAGE_PRECISION)
def f3(spark, d):
    """All vectors of a query's label are relevant: counted by label, and the label compared on retrieved rows only."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = vectors.groupBy("label").agg(F.count("*").alias("n"))
    found = RQ.dense(spark, d).join(vectors.withColumnRenamed("label", "own"), "vec_id").join(asked, "query_id").where("own = label")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    summed = found.withColumn("p", nth / F.col("rank")).groupBy("query_id").agg(F.sum("p").alias("s"))
    rows = asked.join(relevant, "label").join(summed, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n"), 9).alias("ap"))


@query("f4_ndcg_at_k", f"{RANKS_SQL} SELECT query_id, round(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0::DOUBLE END, 9) AS ndcg10 FROM r1")
def f4(spark, d):
    return ranks(spark, d, 1).select("query_id", F.round(E.ndcg_at(F.col("rank"), 10), 9).alias("ndcg10"))


@query("f5_ir_metrics", f'{RANKS_SQL}, m AS ({METRICS_SQL} FROM r2) SELECT * REPLACE (round("ndcg@5", 9) AS "ndcg@5", round("ndcg@10", 9) AS "ndcg@10") FROM m')
def f5(spark, d):
    rows = E.ir_metrics(ranks(spark, d, 2))
    return rows.withColumns({m: F.round(f"`{m}`", 9) for m in ("ndcg@5", "ndcg@10")})


@query("f6_average_metrics", f"{RANKS_SQL}, m AS ({METRICS_SQL} FROM r2) SELECT {AVERAGES} FROM m")
def f6(spark, d):
    return E.average_metrics(E.ir_metrics(ranks(spark, d, 2)))


@query("f7_dedupe_ranked_parents", f"{RANKS_SQL} SELECT query_id, item, rank FROM parents")
def f7(spark, d):
    return E.dedupe_ranked_parents(parents(spark, d), "item")


@query(
    "f8_compare_stages",
    f"""
    {RANKS_SQL}, m1 AS ({METRICS_SQL} FROM r1), m2 AS ({METRICS_SQL} FROM r2), a1 AS (SELECT {AVERAGES} FROM m1), a2 AS (SELECT {AVERAGES} FROM m2),
    u1 AS (UNPIVOT a1 ON COLUMNS(*) INTO NAME metric VALUE vector), u2 AS (UNPIVOT a2 ON COLUMNS(*) INTO NAME metric VALUE pipeline)
    SELECT metric, vector, pipeline, CASE WHEN pipeline > vector THEN 'pipeline' WHEN pipeline < vector THEN 'vector' ELSE 'tie' END AS best FROM u1 JOIN u2 USING (metric)
    """,
)
def f8(spark, d):
    one, two = both_stages(spark, d)
    return E.compare_stages(one, two)


@query(
    "f9_latency_stats",
    """
    SELECT event_type, count(value) AS n, round(avg(value), 1) AS mean_ms, round(median(value), 1) AS median_ms, round(quantile_disc(value, 0.95), 1) AS p95_ms,
        round(quantile_disc(value, 0.99), 1) AS p99_ms, round(min(value), 1) AS min_ms, round(max(value), 1) AS max_ms FROM events GROUP BY 1
    """,
)
def f9(spark, d):
    return E.latency_stats(table(spark, d, "events"), "value", ["event_type"])


_JUDGE_TEMPLATE = "Q: {question}\n{context}\nA: {answer}\n{ground_truth_block}END"


@query(
    "f10_judge_prompt",
    f"""
    WITH {RQ.RANKED_SQL}, l AS ({RQ._LISTED}), x AS (SELECT l.query_id, string_agg(concat('[Sub-chunk ', rank, ' — ', source, format('  [CE score: {{:.3f}}]', ce_score), ']', chr(10), l.text), concat(chr(10), chr(10)) ORDER BY rank) AS s
        FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE rank <= 6 GROUP BY 1)
    SELECT q.query_id, concat('Q: ', question, chr(10), coalesce(s, '(no context retrieved)'), chr(10), 'A: answer ', q.query_id, chr(10),
        CASE WHEN q.query_id % 100 = 0 THEN concat(chr(10), 'GROUND TRUTH ANSWER:', chr(10), 'truth', chr(10)) ELSE '' END, 'END') AS prompt FROM questions q LEFT JOIN x USING (query_id)
    """,
)
def f10(spark, d):
    asked = RQ.questions(spark, d).withColumn("answer", F.concat(F.lit("answer "), F.col("query_id").cast("string")))
    asked = asked.withColumn("ground_truth", F.when(F.col("query_id") % 100 == 0, "truth"))
    return E.judge_prompt(asked, RQ.cited_rows(spark, d), _JUDGE_TEMPLATE)


# Judge replies made from labels: plain, fenced, with words around, malformed; the recall key on every fourth.
def _judge_replies(spark, d):
    key = F.col("doc_id")

    def s(n):
        return (key % n + 1).cast("string")

    recall = F.when(key % 4 == 0, F.concat(F.lit(', "context_recall": '), s(5))).otherwise("")
    body = F.concat(F.lit('{"faithfulness": '), s(5), F.lit(', "answer_relevance": '), s(3), F.lit(', "context_precision": '), s(4), recall, F.lit("}"))
    raw = (
        F.when(key % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(key % 7 == 1, F.concat(F.lit("My verdict: "), body, F.lit(" as asked.")))
        .when(key % 7 == 2, F.lit("no verdict"))
        .otherwise(body)
    )
    return table(spark, d, "labels").select(key.alias("id"), raw.alias("raw"))


_JUDGED_SQL = """
    judged AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 2 THEN (doc_id % 5 + 1)::DOUBLE END AS faithfulness, CASE WHEN doc_id % 7 <> 2 THEN (doc_id % 3 + 1)::DOUBLE END AS answer_relevance,
        CASE WHEN doc_id % 7 <> 2 THEN (doc_id % 4 + 1)::DOUBLE END AS context_precision, CASE WHEN doc_id % 7 <> 2 AND doc_id % 4 = 0 THEN (doc_id % 5 + 1)::DOUBLE END AS context_recall FROM labels)
"""


@query("f11_parse_judge", f"WITH {_JUDGED_SQL} SELECT * FROM judged")
def f11(spark, d):
    return _judge_replies(spark, d).select("id", E.parse_judge(F.col("raw")).alias("j")).select("id", "j.*")


@query(
    "f12_judge_averages",
    f"WITH {_JUDGED_SQL} SELECT round(avg(faithfulness), 3) AS avg_faithfulness, round(avg(answer_relevance), 3) AS avg_answer_relevance, round(avg(context_precision), 3) AS avg_context_precision, round(avg(context_recall), 3) AS avg_context_recall, count(faithfulness) AS evaluated FROM judged",
)
def f12(spark, d):
    return E.judge_averages(f11(spark, d))


@query("f13_sample_eval_chunks", "SELECT doc_id, source FROM documents WHERE length(text) >= 200 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 90")
def f13(spark, d):
    return E.sample_eval_chunks(table(spark, d, "documents"), 30).select("doc_id", "source")


@query(
    "f14_take_first_valid",
    """
    SELECT row_number() OVER (ORDER BY doc_id) AS id, concat('q', doc_id) AS question, concat('a', doc_id) AS answer, doc_id
    FROM (SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 > 0 ORDER BY doc_id LIMIT 100)
    """,
)
def f14(spark, d):
    n = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"question": "q'), n, F.lit('", "answer": "a'), n, F.lit('"}'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"question": "q'), n, F.lit('"}'))).when(F.col("doc_id") % 5 == 0, "nothing").otherwise(
        F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    )
    return E.take_first_valid(table(spark, d, "documents").select("doc_id", raw.alias("raw")), 100, "doc_id")


def report(spark, d):
    """A nested summary of averages and latencies as one row."""
    one, two = both_stages(spark, d)
    latency = E.latency_stats(table(spark, d, "events"), "value")
    stages = one.select(F.struct("*").alias("stage1_vector")).join(two.select(F.struct("*").alias("stage2_full_pipeline")), F.lit(True))
    retrieval = stages.join(latency.select(F.struct("*").alias("latency")), F.lit(True))
    generation = f12(spark, d).select(F.struct("*").alias("generation"))
    rows = retrieval.select(F.struct("*").alias("retrieval")).join(generation, F.lit(True))
    return rows.select(F.struct("*").alias("summary"))


@query(
    "f15_assemble_report",
    f"""
    {RANKS_SQL}, {_JUDGED_SQL}, m1 AS ({METRICS_SQL} FROM r1), m2 AS ({METRICS_SQL} FROM r2), a1 AS (SELECT {AVERAGES} FROM m1), a2 AS (SELECT {AVERAGES} FROM m2),
    l AS (SELECT count(value)::DOUBLE AS n, round(avg(value), 1) AS mean_ms, round(median(value), 1) AS median_ms, round(quantile_disc(value, 0.95), 1) AS p95_ms,
        round(quantile_disc(value, 0.99), 1) AS p99_ms, round(min(value), 1) AS min_ms, round(max(value), 1) AS max_ms FROM events),
    g AS (SELECT round(avg(faithfulness), 3) AS avg_faithfulness, round(avg(answer_relevance), 3) AS avg_answer_relevance, round(avg(context_precision), 3) AS avg_context_precision,
        round(avg(context_recall), 3) AS avg_context_recall, count(faithfulness)::DOUBLE AS evaluated FROM judged),
    u1 AS (UNPIVOT a1 ON COLUMNS(*) INTO NAME metric VALUE value), u2 AS (UNPIVOT a2 ON COLUMNS(*) INTO NAME metric VALUE value),
    ul AS (UNPIVOT l ON COLUMNS(*) INTO NAME metric VALUE value), ug AS (UNPIVOT g ON COLUMNS(*) INTO NAME metric VALUE value)
    SELECT concat('retrieval.stage1_vector.', metric) AS path, value FROM u1 UNION ALL SELECT concat('retrieval.stage2_full_pipeline.', metric), value FROM u2
    UNION ALL SELECT concat('retrieval.latency.', metric), value FROM ul UNION ALL SELECT concat('generation.', metric), value FROM ug
    """,
)
def f15(spark, d):
    return E.report_values(report(spark, d))


@query(
    "f16_threshold_gate",
    f"""
    {RANKS_SQL}, {_JUDGED_SQL}, m AS ({METRICS_SQL} FROM r2), a AS (SELECT {AVERAGES} FROM m),
    vals AS (SELECT 'retrieval.stage2_full_pipeline.hit@5' AS path, "hit@5" AS value FROM a UNION ALL SELECT 'retrieval.stage2_full_pipeline.mrr', mrr FROM a
        UNION ALL SELECT 'generation.avg_faithfulness', round(avg(faithfulness), 3) FROM judged UNION ALL SELECT 'retrieval.latency.p95_ms', round(quantile_disc(value, 0.95), 1) FROM events),
    th(path, cmp, bound) AS (VALUES ('retrieval.stage2_full_pipeline.hit@5', 'min', 0.95::DOUBLE), ('retrieval.stage2_full_pipeline.mrr', 'min', 0.85), ('generation.avg_faithfulness', 'min', 4.2),
        ('generation.missing', 'min', 1.0), ('retrieval.latency.p95_ms', 'max', 12000)),
    g AS (SELECT th.*, v.value, coalesce(CASE WHEN cmp = 'min' THEN value >= bound ELSE value <= bound END, false) AS ok FROM th LEFT JOIN vals v USING (path))
    SELECT *, (SELECT bool_and(ok) FROM g) AS all_ok FROM g
    """,
)
def f16(spark, d):
    bounds = [t for t in E.THRESHOLDS if t[0] != "generation.avg_context_precision"] + [("generation.missing", "min", 1.0)]
    thresholds = spark.createDataFrame(bounds, "path string, cmp string, bound double")
    values = written(E.report_values(report(spark, d)), "values")  # read twice by the gate
    return E.threshold_gate(values, thresholds)


_RUNS_SQL = """
    runs AS (SELECT concat('run', user_id) AS name, min(ts) AS ts, round(avg(value), 6) AS mrr, count(*)::DOUBLE AS n,
        CASE user_id % 4 WHEN 0 THEN concat('{"summary": {"n": ', count(*), '}, "results": []}') WHEN 1 THEN '{"summary": {}}' WHEN 2 THEN '{"results": []}' ELSE 'no json' END AS raw
        FROM events GROUP BY user_id)
"""


def runs(spark, d):
    user = F.col("user_id")
    rows = table(spark, d, "events").groupBy("user_id").agg(
        F.min("ts").alias("ts"), F.round(F.avg("value"), 6).alias("mrr"), F.count("*").cast("double").alias("n")
    )
    whole = F.concat(F.lit('{"summary": {"n": '), F.col("n").cast("long").cast("string"), F.lit('}, "results": []}'))
    raw = F.when(user % 4 == 0, whole).when(user % 4 == 1, '{"summary": {}}').when(user % 4 == 2, '{"results": []}').otherwise("no json")
    return rows.select(F.concat(F.lit("run"), user.cast("string")).alias("name"), "ts", "mrr", "n", raw.alias("raw"))


@query("f17_report_shape_valid", f"WITH {_RUNS_SQL} SELECT name, contains(raw, 'summary') AND contains(raw, 'results') AS valid FROM runs")
def f17(spark, d):
    return runs(spark, d).select("name", E.report_shape_valid(F.col("raw")).alias("valid"))


@query(
    "f18_run_trend",
    f"""
    WITH {_RUNS_SQL} SELECT name, ts, mrr, n, round(mrr - lag(mrr) OVER w, 6) AS mrr_change, round(n - lag(n) OVER w, 6) AS n_change, row_number() OVER w AS place
    FROM runs WHERE contains(raw, 'summary') WINDOW w AS (ORDER BY ts, name)
    """,
)
def f18(spark, d):
    rows = runs(spark, d)
    return E.run_trend(rows.drop("raw"), rows.where("contains(raw, 'summary')").select("name"), ["mrr", "n"])


@query(
    "f19_merge_runs",
    f"""
    WITH {_RUNS_SQL}, up AS (SELECT name, mrr + 1 AS mrr FROM runs WHERE n % 2 = 0)
    SELECT name, mrr, true AS upload FROM up UNION ALL SELECT name, mrr, false FROM runs WHERE name NOT IN (SELECT name FROM up)
    """,
)
def f19(spark, d):
    rows = runs(spark, d)
    return E.merge_runs(rows.select("name", "mrr"), rows.where("n % 2 = 0").select("name", (F.col("mrr") + 1).alias("mrr")))


@query("f20_worst_questions", f"WITH {_JUDGED_SQL} SELECT id, faithfulness FROM judged ORDER BY coalesce(faithfulness, 5), id LIMIT 25")
def f20(spark, d):
    return E.worst_questions(f11(spark, d).select("id", "faithfulness"))


@query(
    "f21_load_summary",
    """
    WITH l AS (SELECT value * 40 AS duration_ms, event_type = 'error' AS failed, concat('data: a', chr(10), 'data: b', CASE WHEN event_id % 3 = 0 THEN ' data:' ELSE '' END) AS body FROM events),
    s AS (SELECT count(*) AS requests, quantile_disc(duration_ms, 0.95) AS p95_ms, round(avg(failed::INT), 6) AS failed_rate, round(avg(len(regexp_extract_all(body, 'data:'))), 4) AS frames FROM l)
    SELECT *, p95_ms < 15000 AND failed_rate < 0.05 AS passed FROM s
    """,
)
def f21(spark, d):
    body = F.concat(F.lit("data: a\ndata: b"), F.when(F.col("event_id") % 3 == 0, " data:").otherwise(""))
    log = table(spark, d, "events").select(
        (F.col("value") * 40).alias("duration_ms"), (F.col("event_type") == "error").alias("failed"), body.alias("body")
    )
    return E.load_summary(log)
