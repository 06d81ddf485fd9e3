"""Evaluation: ranking metrics, latencies, judge scores, reports, gates and trends."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip_fence
from millrace.sources.scratch import written
from millrace.sources.tables import numbered

METRICS = ["hit@1", "hit@3", "hit@5", "hit@10", "mrr", "map", "ndcg@5", "ndcg@10"]
JUDGE = "faithfulness double, answer_relevance double, context_precision double, context_recall double"
# The gate's paths, comparators and bounds.
THRESHOLDS = [
    ("retrieval.stage2_full_pipeline.hit@5", "min", 0.95),
    ("retrieval.stage2_full_pipeline.mrr", "min", 0.85),
    ("generation.avg_faithfulness", "min", 4.20),
    ("generation.avg_context_precision", "min", 3.40),
    ("retrieval.latency.p95_ms", "max", 12000.0),
]


def find_rank(questions: DataFrame, ranked: DataFrame, item: str = "item") -> DataFrame:
    """``(query_id, rank)``: place of each question's ``relevant`` item in its list, -1 where absent."""
    hits = ranked.join(questions.select("query_id", F.col("relevant").alias(item)), ["query_id", item], "left_semi")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("rank"))
    out = questions.select("query_id").join(first, "query_id", "left")
    return out.select("query_id", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


def hit_at(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0).otherwise(0.0)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank >= 1, 1.0 / rank).otherwise(0.0)


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def ir_metrics(ranks: DataFrame) -> DataFrame:
    """One row of metrics per question. With one relevant item the average precision equals the reciprocal rank."""
    r = F.col("rank")
    columns = [hit_at(r, k).alias(f"hit@{k}") for k in (1, 3, 5, 10)]
    columns += [reciprocal_rank(r).alias("mrr"), reciprocal_rank(r).alias("map")]
    return ranks.select("query_id", *columns, ndcg_at(r, 5).alias("ndcg@5"), ndcg_at(r, 10).alias("ndcg@10"))


def average_precision(relevant: DataFrame, ranked: DataFrame, item: str = "item") -> DataFrame:
    """``(query_id, ap)`` for any number of relevant items per question, given as rows ``(query_id, item)``."""
    hits = ranked.join(relevant, ["query_id", item], "left_semi")
    running = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = hits.withColumn("p", running / F.col("rank")).groupBy("query_id").agg(F.sum("p").alias("s"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n")).join(found, "query_id", "left")
    return wanted.select("query_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))


def average_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(f"`{m}`"), 4).alias(m) for m in METRICS])


def dedupe_ranked_parents(ranked: DataFrame, parent: str) -> DataFrame:
    """Each parent keeps the place of its first appearance; places are then numbered densely."""
    first = ranked.groupBy("query_id", parent).agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return first.select("query_id", parent, place.cast("long").alias("rank"))


def compare_stages(vector: DataFrame, pipeline: DataFrame) -> DataFrame:
    """``(metric, vector, pipeline, best)`` from two rows of average metrics."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.unpivot([], [F.col(f"`{m}`") for m in METRICS], "metric", name)

    both = long(vector, "vector").join(long(pipeline, "pipeline"), "metric")
    best = F.when(F.col("pipeline") > F.col("vector"), "pipeline").when(F.col("pipeline") < F.col("vector"), "vector").otherwise("tie")
    return both.withColumn("best", best)


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: list[str] = ()) -> DataFrame:
    """For each key of ``by`` the values at the given places of the ascending values: ``ranks`` maps names to place(n).

    Values are counted (pre-aggregated) and dealt by ranges of key and value, so no task holds a key's values. The
    counts of the ranges, a row for each, say in which range a place lies; only those ranges are summed value by value.
    Nulls do not count; a key without values has no row.
    """
    keys = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = written(counted.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "values")
    own = Window.partitionBy(*keys)
    earlier = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_m").over(earlier), F.lit(0)), "_all": F.sum("_m").over(own)})
    places = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_all")).cast("long").alias("place")) for name, place in ranks.items()])
    wanted = sums.withColumn("_p", F.explode(places)).where((F.col("_p.place") > F.col("_before")) & (F.col("_p.place") <= F.col("_before") + F.col("_m")))
    names = {k: f"_of_{k}" for k in [*keys, "_range"]}
    wanted = wanted.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_p.name").alias("_name"), (F.col("_p.place") - F.col("_before")).alias("_place"))
    wanted = written(wanted, "places")  # a row for each key and name
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    inside = ranged.join(wanted, same, "left_semi").withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v")))
    found = inside.join(wanted, same).where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_n")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """The place of the nearest-rank percentile among n values."""
    return lambda n: F.greatest(F.ceil(n * share - 1e-9), F.lit(1))


def latency_stats(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, median, nearest-rank p95 and p99, least and most, to one decimal; exact, whatever a key's size."""
    places = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor((n + 2) / 2), "_p95": nearest_rank(0.95), "_p99": nearest_rank(0.99)}
    found = order_statistics(rows, value, places, by)
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_mean"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    found = found.select(*[F.col(k).alias(f"_of_{k}") for k in by], *places)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by] or F.lit(True)  # one row each without keys
    return plain.join(found, same, "left").select(
        *by,
        "n",
        F.round("_mean", 1).alias("mean_ms"),
        F.round((F.col("_low") + F.col("_high")) / 2, 1).alias("median_ms"),
        F.round("_p95", 1).alias("p95_ms"),
        F.round("_p99", 1).alias("p99_ms"),
        F.round("_min", 1).alias("min_ms"),
        F.round("_max", 1).alias("max_ms"),
    )


def judge_prompt(questions: DataFrame, ranked: DataFrame, template: str, most: int = 6) -> DataFrame:
    """``(query_id, prompt)``: the template with question, sources, answer and, where known, the expected answer."""
    note = F.when(F.col("ce_score").isNotNull(), F.format_string("  [CE score: %.3f]", "ce_score")).otherwise("")
    line = F.concat(F.lit("[Sub-chunk "), F.col("rank").cast("string"), F.lit(" — "), "source", note, F.lit("]\n"), "text")
    kept = ranked.where(F.col("rank") <= most).select("query_id", F.struct(F.col("rank").alias("o"), line.alias("l")).alias("x"))
    context = kept.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["l"], "\n\n").alias("context"))
    rows = questions.join(context, "query_id", "left")
    truth = F.when(F.coalesce("ground_truth", F.lit("")) != "", F.concat(F.lit("\nGROUND TRUTH ANSWER:\n"), "ground_truth", F.lit("\n")))
    prompt = F.lit(template)
    places = {
        "{question}": F.col("question"),
        "{context}": F.coalesce("context", F.lit("(no context retrieved)")),
        "{answer}": F.col("answer"),
        "{ground_truth_block}": F.coalesce(truth, F.lit("")),
    }
    for place, value in places.items():
        prompt = F.replace(prompt, F.lit(place), value)
    return rows.select("query_id", prompt.alias("prompt"))


def parse_judge(raw: Column) -> Column:
    """Scores of a judge's reply: the whole reply as JSON, else its first flat object, else nulls."""
    plain = strip_fence(raw)
    whole = F.from_json(plain, JUDGE)
    inner = F.from_json(F.regexp_extract(plain, r"(?s)\{[^{}]*\}", 0), JUDGE)
    none = whole["faithfulness"].isNull() & whole["answer_relevance"].isNull() & whole["context_precision"].isNull()
    return F.when(none, inner).otherwise(whole)


def judge_averages(scores: DataFrame) -> DataFrame:
    """Averages to three decimals over the rows that have each score."""
    names = ["faithfulness", "answer_relevance", "context_precision", "context_recall"]
    return scores.agg(*[F.round(F.avg(n), 3).alias(f"avg_{n}") for n in names], F.count("faithfulness").alias("evaluated"))


def sample_eval_chunks(chunks: DataFrame, count: int, least: int = 200, key: str = "doc_id") -> DataFrame:
    """The 3 x ``count`` chunks of ``least`` characters or more that come first by a hash of their id."""
    order = F.md5(F.col(key).cast("string").cast("binary"))
    return chunks.where(F.length("text") >= least).orderBy(order, key).limit(3 * count)


def take_first_valid(replies: DataFrame, n: int, order: str) -> DataFrame:
    """Question and answer pairs from replies where both keys are present, the first ``n`` in order, numbered from 1."""
    parsed = F.from_json(strip_fence(F.col("raw")), "question string, answer string")
    rows = replies.select(order, parsed.alias("q")).where("q.question IS NOT NULL AND q.answer IS NOT NULL")
    first = rows.orderBy(order).limit(n)
    return first.select(F.row_number().over(Window.orderBy(order)).cast("long").alias("id"), "q.question", "q.answer", order)


def report_values(report: DataFrame, column: str = "summary") -> DataFrame:
    """``(path, value)``: every numeric leaf of a nested struct with its dotted path."""
    kind = report.schema[column].dataType

    def leaves(prefix: list[str], fields) -> list[list[str]]:
        out = []
        for f in fields:
            path = [*prefix, f.name]
            out += leaves(path, f.dataType.fields) if hasattr(f.dataType, "fields") else [path]
        return out

    def entry(path: list[str]) -> Column:
        value = F.col(column)
        for name in path:
            value = value.getField(name)
        return F.struct(F.lit(".".join(path)).alias("path"), value.cast("double").alias("value"))

    return report.select(F.explode(F.array(*[entry(p) for p in leaves([], kind.fields)])).alias("x")).select("x.*")


def threshold_gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(path, cmp, bound, value, ok, all_ok)``; a missing value fails. ``thresholds`` is a bounded table."""
    rows = F.broadcast(thresholds).join(values.where("value IS NOT NULL"), "path", "left")
    ok = F.when(F.col("cmp") == "min", F.col("value") >= F.col("bound")).when(F.col("cmp") == "max", F.col("value") <= F.col("bound"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.join(rows.agg(F.bool_and("ok").alias("all_ok")), F.lit(True))  # one row


def report_shape_valid(report: Column) -> Column:
    """Whether a JSON report has a retrieval or generation summary and a list of results."""
    summary = F.get_json_object(report, "$.summary")
    return F.coalesce(summary.isNotNull() & F.get_json_object(report, "$.results").startswith("["), F.lit(False))


def run_trend(runs: DataFrame, selected: DataFrame, metrics: list[str]) -> DataFrame:
    """The selected runs with their place, oldest first, each metric and its change from the run before.

    Places come from ranges, and each run meets the one before by its place, so no task gets all runs.
    """
    rows = numbered(runs.join(selected, "name", "left_semi"), [], [F.col("ts"), F.col("name")])
    rows = written(rows.select("name", "ts", *metrics, "place"), "runs")
    before = rows.select((F.col("place") + 1).alias("place"), *[F.col(m).alias(f"_{m}") for m in metrics])
    deltas = [F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"{m}_change") for m in metrics]
    return rows.join(before, "place", "left").select("name", "ts", *metrics, *deltas, "place")


def merge_runs(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads override stored runs of the same name; ``upload`` marks them."""
    fresh = uploads.withColumn("upload", F.lit(True))
    old = stored.join(uploads.select("name"), "name", "left_anti").withColumn("upload", F.lit(False))
    return fresh.unionByName(old)


def worst_questions(scores: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` questions of least faithfulness; a missing score counts as 5."""
    return scores.orderBy(F.coalesce("faithfulness", F.lit(5.0)), "id").limit(n)


def load_summary(log: DataFrame, limit_ms: float = 15_000, limit_failed: float = 0.05) -> DataFrame:
    """One row: exact p95 of durations, share of failed requests, frames per response, and whether both limits hold."""
    p95 = order_statistics(log, "duration_ms", {"p95_ms": nearest_rank(0.95)})
    out = log.agg(
        F.count("*").alias("requests"),
        F.round(F.avg(F.col("failed").cast("int")), 6).alias("failed_rate"),
        F.round(F.avg(F.regexp_count("body", F.lit("data:"))), 4).alias("frames"),
    )
    out = out.join(p95, F.lit(True), "left").select("requests", "p95_ms", "failed_rate", "frames")  # one row each
    return out.withColumn("passed", (F.col("p95_ms") < limit_ms) & (F.col("failed_rate") < limit_failed))
