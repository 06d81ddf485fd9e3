"""Batch retrieval: dense and lexical top-k, rank fusion, hydration, reranking, confidence, prompt tables."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens, truncate_preview, word_count, words
from millrace.operators.chunking import sub_chunks
from millrace.sources.scratch import importable_on_workers, written

K1, B = 1.2, 0.75


def top_k(rows: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1. Partial top-k runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(rank, place.cast("long")).where(F.col(rank) <= k)


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", block: int = 4096
) -> DataFrame:
    """``(query_id, vec_id, rank, score)``: the ``k`` vectors of greatest cosine for each query vector.

    ``queries`` is a stated query set; it is taken in blocks of at most ``block`` vectors, and each block is sent to
    the tasks that scan ``vectors`` once, multiply matrices and emit ``k`` candidates per query and batch.
    Scores are rounded to 6 decimals and ties go to the smaller id. Null or zero vectors match nothing.
    """
    spark = queries.sparkSession
    importable_on_workers(spark)
    sound = F.exists("embedding", lambda x: x != 0)
    asked = queries.where(sound).select(F.col(query_id).alias("q"), F.col("embedding").cast("array<double>").alias("v"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    scanned = vectors.where(sound).select(F.col(vec_id).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    schema = "query long, id long, score double"
    parts = []
    for number in range(blocks):
        rows = asked.where(F.col("block") == number).select("q", "v").toArrow()  # a block, of bounded size
        ids = rows.column("q").to_numpy()
        if not len(ids):
            continue
        table = np.stack(rows.column("v").to_pylist())
        table /= np.linalg.norm(table, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, table))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, table = sent.value
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    best, at = nearest(table, batch.column(1), own, k)
                    columns = [np.repeat(ids, best.shape[1]), own[at].ravel(), best.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "id", "score"])

        parts.append(scanned.mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], f"{query_id} long, {vec_id} long, rank long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = top_k(out, "query", [F.desc("score"), F.asc("id")], k)
    return best.select(F.col("query").alias(query_id), F.col("id").alias(vec_id), "rank", "score")


def nearest(table: np.ndarray, vectors: pa.Array, ids: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Scores and row numbers of the ``k`` best of a batch's vectors for each query, ties to the smaller id.

    The batch is taken in slices of ``rows``, so a product is no larger than the block of queries by that. Scores in
    millionths and the place of an id in the batch make one whole number, whose ``k`` smallest are kept.
    """
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    kept = np.zeros((len(table), 0), np.int64)
    for low in range(0, len(ids), rows):
        part = np.stack(vectors.slice(low, rows).to_pylist())
        part /= np.linalg.norm(part, axis=1, keepdims=True)
        worse = 1_000_000 - np.rint(table @ part.T * 1e6).astype(np.int64)
        kept = np.concatenate([kept, worse * len(ids) + place[low : low + rows]], axis=1)
        if kept.shape[1] > k:
            kept = np.partition(kept, k - 1, axis=1)[:, :k]
    kept.sort(axis=1)
    at = np.argsort(place)[kept % len(ids)]
    return (1_000_000 - kept // len(ids)) / 1e6, at


def bm25_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "chunk_text", terms: DataFrame | None = None) -> DataFrame:
    """Postings ``(term, chunk_id, weight)``: term weight times inverse document frequency, of all or the given terms.

    Texts are cut into terms once, in a written table, from which the number and mean length of chunks (one row, broadcast)
    come as well. ``terms(term)`` keeps other terms out of the groupings by (term, chunk) and by term. The postings are a
    written table, so a join on a frequent term has plain exchanges, which adaptive execution splits.
    """
    rows = chunks.select(chunk_id, tokens(F.col(text)).alias("_t"))
    rows = written(rows.withColumn("len", F.size("_t")), "terms")
    found = rows.select(chunk_id, "len", F.explode("_t").alias("term"))
    if terms is not None:
        found = found.join(terms.select("term").distinct(), "term", "left_semi")
    tf = found.groupBy("term", chunk_id).agg(F.count("*").alias("f"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    corpus = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    joined = tf.join(df, "term").join(F.broadcast(corpus), F.lit(True))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return written(joined.select("term", chunk_id, (idf * weight).alias("weight")), "postings")


def question_terms(questions: DataFrame) -> DataFrame:
    """``(query_id, term)``: the distinct terms of each question."""
    return questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def bm25_topk(questions: DataFrame, postings: DataFrame, k: int, chunk_id: str = "chunk_id") -> DataFrame:
    """``(query_id, <chunk_id>, rank, score)``: postings of the distinct question terms, summed, best ``k`` each.

    An equi-join on the term; scores are rounded to 6 decimals, ties go to the smaller id.
    """
    scored = question_terms(questions).join(postings, "term").groupBy("query_id", chunk_id).agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.asc(chunk_id)], k).select("query_id", chunk_id, "rank", "score")


def rrf_fuse(lists: list[DataFrame], n: int, k: int = 60, item: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(query_id, item, rank)``: sum of 1 / (k + rank), best ``n`` each."""
    rows = lists[0].select("query_id", item, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", item, "rank"))
    fused = rows.groupBy("query_id", item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return top_k(fused, "query_id", [F.desc("score"), F.asc(item)], n).select("query_id", item, "rank", "score")


def search_with_scores(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.col("score").alias("similarity"), (1 - F.col("score")).alias("distance"))


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk's text and document's fields; hits without a chunk or document fall away."""
    return hits.join(chunks, "chunk_id").join(documents, "doc_id")


def metadata_merge(rows: DataFrame, json: str, fields: list[str]) -> DataFrame:
    """Fill the given string fields from a JSON column where they are null; malformed JSON fills nothing."""
    parsed = F.from_json(json, ", ".join(f"{f} string" for f in fields))
    out = rows.withColumn("_m", parsed)
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"_m.{f}")))
    return out.drop("_m")


def document_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks of the given documents with their place."""
    return chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def context_window(hits: DataFrame, chunks: DataFrame, w: int = 1) -> DataFrame:
    """Neighbours of each hit ``(doc_id, chunk_order)`` within ``w`` places in its document, itself included.

    Each hit asks for its 2w + 1 places by an equi-join, so no range join is needed.
    """
    places = hits.select(
        "doc_id",
        F.col("chunk_order").alias("hit_order"),
        F.explode(F.sequence(F.col("chunk_order") - w, F.col("chunk_order") + w)).alias("chunk_order"),
    )
    return places.join(chunks, ["doc_id", "chunk_order"])


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.size(asked), 6)


class BatchScorer:
    """A scorer of lists: ``fn(questions, texts)`` gives a score for each pair, as cross-encoders take their input.

    Each distinct pair is scored once, in batches of ``size``. A batch that fails is scored again pair by pair; a pair that
    fails by itself has a null score and takes no other with it.
    """

    def __init__(self, fn: Callable[[list[str], list[str]], list[float]], size: int = 256):
        self.fn, self.size = fn, size

    def score(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """``rows(question, <text>, ...)`` with the score of their pair; null where one of the two is null."""
        importable_on_workers(rows.sparkSession)
        fn, size = self.fn, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, size):
                    part = batch.slice(low, size)
                    pairs = part.column(0).to_pylist(), part.column(1).to_pylist()
                    try:
                        scores = [float(x) for x in fn(*pairs)]
                    except Exception:  # any failure of a model concerns its batch only
                        scores = [_score_or_none(fn, *pair) for pair in zip(*pairs, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], ["_question", "_text", "_score"])

        distinct = rows.select(F.col("question").alias("_question"), F.col(text).alias("_text")).where("_question IS NOT NULL AND _text IS NOT NULL").distinct()
        # Written, so that a pair is scored once however often the result is read.
        scored = written(distinct.mapInArrow(run, "_question string, _text string, _score double"), "scores")
        found = rows.join(scored, (F.col("question") == F.col("_question")) & (F.col(text) == F.col("_text")), "left")
        return found.withColumn(name, F.col("_score")).drop("_question", "_text", "_score")


def _score_or_none(fn: Callable, question: str, text: str) -> float | None:
    try:
        return float(fn([question], [text])[0])
    except Exception:
        return None


def rerank_sub_chunks(
    parents: DataFrame,
    questions: DataFrame,
    scorer: Callable[[Column, Column], Column] | BatchScorer = lexical_score,
    threshold: float = -10.0,
    parents_kept: int = 10,
    kept: int = 10,
) -> DataFrame:
    """Split each question's best parents into sub-chunks, score them, keep the best of those at the threshold or above.

    ``parents(query_id, rank, chunk_id, chunk_text, similarity)``; ``scorer`` maps question and text columns to a score,
    or is a :class:`BatchScorer`; sub-chunks without a score fall away.
    """
    rows = score_sub_chunks(parents, questions, scorer, parents_kept).where(F.col("ce_score") >= threshold)
    order = [F.desc("ce_score"), F.asc("parent_rank"), F.asc("sub_order")]
    return top_k(rows, "query_id", order, kept)


def score_sub_chunks(parents: DataFrame, questions: DataFrame, scorer=lexical_score, parents_kept: int = 10) -> DataFrame:
    rows = parents.where(F.col("rank") <= parents_kept).withColumnRenamed("rank", "parent_rank")
    rows = sub_chunks(rows.select("query_id", "parent_rank", "chunk_id", "chunk_text", "similarity"))
    rows = rows.join(questions.select("query_id", "question"), "query_id")
    if isinstance(scorer, BatchScorer):
        rows = scorer.score(rows, "sub_text", "ce_score")
    else:
        rows = rows.withColumn("ce_score", scorer(F.col("question"), F.col("sub_text")))
    return rows.select("query_id", "parent_rank", F.col("chunk_id").alias("parent_chunk_id"), "sub_order", "sub_text", "similarity", "ce_score")


def no_rerank_fallback(parents: DataFrame, kept: int = 10) -> DataFrame:
    return parents.where(F.col("rank") <= kept)


def confidence_summary(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Greatest and mean score and number of sub-chunks; questions without any stay, with nulls and 0."""
    found = ranked.groupBy("query_id").agg(
        F.max("ce_score").alias("max_ce"), F.round(F.avg("ce_score"), 6).alias("mean_ce"), F.count("*").alias("passed_chunks")
    )
    out = questions.select("query_id").join(found, "query_id", "left")
    return out.withColumn("passed_chunks", F.coalesce("passed_chunks", F.lit(0).cast("long")))


def confidence_gate(summary: DataFrame, floor: float = 0.0, least: int = 2) -> DataFrame:
    low = F.col("max_ce").isNull() | (F.col("max_ce") < floor) | (F.col("passed_chunks") < least)
    return summary.withColumn("level", F.when(low, "low").otherwise("normal"))


def expand_query(messages: DataFrame, queries: DataFrame, recent: int = 3, terms: int = 3) -> DataFrame:
    """Add up to ``terms`` words of the last ``recent`` user messages to each question of a conversation.

    ``messages(conv_id, turn, role, text)``, ``queries(conv_id, query)``. Words of more than three characters that
    the question lacks, distinct, in order of first appearance (oldest message first).
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.where("role = 'user'").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= recent)
    texts = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    rows = queries.join(texts, "conv_id", "left")
    seen = F.transform(words(F.col("query")), F.lower)
    found = F.flatten(F.transform(F.coalesce("m", F.array()), lambda m: words(m["text"])))
    fresh = F.filter(found, lambda w: (F.length(w) > 3) & ~F.array_contains(seen, F.lower(w)))
    added = F.slice(F.array_distinct(fresh), 1, terms)
    query = F.when(F.size(added) > 0, F.concat("query", F.lit(" "), F.array_join(added, " "))).otherwise(F.col("query"))
    return rows.select("conv_id", query.alias("expanded"))


def retrieval_debug(
    questions: DataFrame, scored: DataFrame, threshold: float, kept: int = 10, shown: int = 5, name: str | None = None
) -> DataFrame:
    """Per question the counts of sub-chunks, passed, rejected and final ones, and the words sent.

    With a column ``name`` also, as texts, the names of the final sub-chunks in order and of the first ``shown`` rejected.
    """
    passed = F.col("ce_score") >= threshold
    place = Window.partitionBy("query_id").orderBy(F.desc("ce_score"), F.asc("parent_rank"), F.asc("sub_order"))
    rows = scored.withColumn("_place", F.row_number().over(place)).withColumn("_words", word_count(F.col("sub_text")))
    final = passed & (F.col("_place") <= kept)
    found = rows.groupBy("query_id").agg(
        F.count("*").alias("total_sub_chunks"),
        F.count_if(passed).alias("passed_threshold"),
        F.count_if(~passed).alias("rejected_by_threshold"),
        F.count_if(final).alias("final_sent"),
        F.coalesce(F.sum(F.when(final, F.col("_words"))), F.lit(0)).alias("words_sent"),
    )
    names = [c for c in found.columns if c != "query_id"]
    out = questions.select("query_id").join(found, "query_id", "left")
    out = out.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    if name is None:
        return out
    finals = ordered_text(rows.where(final), "query_id", "_place", F.col(name), ",", kept, "finals")
    rejected = top_k(rows.where(~passed), "query_id", [F.asc("_place")], shown, "_nth")
    rejected = ordered_text(rejected, "query_id", "_nth", F.col(name), ",", shown, "first_rejected")
    out = out.join(finals, "query_id", "left").join(rejected, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("finals", "first_rejected")})


def ordered_text(rows: DataFrame, key: str, order: str, line: Column, joiner: str, most: int, name: str) -> DataFrame:
    """One text per key: the first ``most`` lines in order, joined."""
    kept = rows.where(F.col(order) <= most).select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("_x"))
    lines = F.array_sort(F.collect_list("_x"))
    grouped = kept.groupBy(key).agg(lines.alias("_xs"))
    return grouped.select(key, F.array_join("_xs.l", joiner).alias(name))


def format_vector_context(ranked: DataFrame, most: int = 10) -> DataFrame:
    """The numbered sources of each question, as one text (fixed values: its words and marks)."""
    percent = F.format_string("%.2f%%", F.col("similarity") * 100)
    line = F.concat(
        F.lit("**Kaynak "), F.col("rank").cast("string"), F.lit("** ("), "source", F.lit(", Benzerlik: "), percent, F.lit("):\n"), "text", F.lit("\n")
    )
    return ordered_text(ranked, "query_id", "rank", line, "\n", most, "vector_context")


def build_messages(questions: DataFrame, vector_context: DataFrame, graph_context: DataFrame, template: str) -> DataFrame:
    """``(query_id, system, user)``: the template with its two places filled in; questions without sources get a note."""
    rows = questions.join(vector_context, "query_id", "left").join(graph_context, "query_id", "left")
    # The notes that stand for missing sources and facts.
    vector = F.coalesce("vector_context", F.lit("İlgili belge parçası bulunamadı."))
    graph = F.coalesce("graph_context", F.lit("İlişkili bilgi bulunamadı."))
    system = F.replace(F.replace(F.lit(template), F.lit("{sources}"), vector), F.lit("{facts}"), graph)
    return rows.select("query_id", system.alias("system"), F.col("question").alias("user"))


def citations(ranked: DataFrame, most: int = 10) -> DataFrame:
    """Numbered citations of each question; a missing document type counts as pdf."""
    return ranked.where(F.col("rank") <= most).select(
        "query_id",
        F.col("rank").alias("index"),
        "source",
        truncate_preview(F.col("text"), 200).alias("content"),
        F.lower(F.coalesce("document_type", F.lit("pdf"))).alias("document_type"),
        F.round("similarity", 4).alias("relevance_score"),
        F.round("ce_score", 4).alias("ce_score"),
    )


def assemble_response(questions: DataFrame, cited: DataFrame, confidence: DataFrame, facts: DataFrame) -> DataFrame:
    """``(query_id, payload)``: one JSON answer payload per question with its citations, graph facts and confidence."""
    listed = cited.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "source", "document_type", "relevance_score", "ce_score"))).alias("citations")
    )
    known = facts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "type", "nodes", "rels"))).alias("facts"))
    rows = questions.join(listed, "query_id", "left").join(known, "query_id", "left").join(confidence, "query_id", "left")
    body = F.struct(
        F.col("question").alias("question"),
        F.coalesce("citations", F.array()).alias("citations"),
        F.coalesce("facts", F.array()).alias("facts"),
        F.struct("level", "max_ce", "mean_ce", "passed_chunks").alias("confidence"),
    )
    return rows.select("query_id", F.to_json(body).alias("payload"))


def citation_usage(answers: DataFrame, offered: DataFrame) -> DataFrame:
    """Each distinct number an answer cites, and whether such a citation was offered."""
    used = answers.select("query_id", F.explode(F.array_distinct("markers")).alias("index"))
    known = offered.select("query_id", "index", F.lit(True).alias("offered"))
    return used.join(known, ["query_id", "index"], "left").withColumn("offered", F.coalesce("offered", F.lit(False)))


def sync_check(chunks: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Chunk and vector counts, ids on one side only, and whether all match."""
    left = chunks.select(key).withColumn("_c", F.lit(1))
    right = points.select(key).withColumn("_v", F.lit(1))
    both = left.join(right, key, "full_outer")
    out = both.agg(
        F.count("_c").alias("n_chunks"),
        F.count("_v").alias("n_vectors"),
        F.count_if(F.col("_v").isNull()).alias("chunks_only"),
        F.count_if(F.col("_c").isNull()).alias("vectors_only"),
    )
    return out.withColumn("in_sync", (F.col("chunks_only") == 0) & (F.col("vectors_only") == 0))


def history_messages(messages: DataFrame, n: int = 6, most: int = 1000) -> DataFrame:
    """The newest ``n`` messages of each conversation as prompt turns, oldest first, long ones cut."""
    recent = top_k(messages, "conv_id", [F.desc("turn")], n, "_r")
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return recent.select("conv_id", place.alias("place"), role.alias("role"), truncate_preview(F.col("text"), most).alias("content"))


def hybrid_retrieve(
    questions: DataFrame, ranked: DataFrame, graph_context: DataFrame, name: Column, floor: float = 0.0, least: int = 2, most: int = 10
) -> DataFrame:
    """``(query_id, question, sources, total_sources, level, graph_context, n_facts)``: what each question is answered from.

    ``ranked`` are the reranked sub-chunks, named by ``name`` in ``sources`` in order of rank; ``graph_context(query_id,
    graph_context, n_facts)`` are the facts of the entities it names. Questions without either stay, with empty texts.
    """
    rows = written(ranked.withColumn("_name", name), "ranked")  # read three times below
    listed = ordered_text(rows, "query_id", "rank", F.col("_name"), ",", most, "sources")
    counted = rows.groupBy("query_id").agg(F.count("*").alias("total_sources"))
    level = confidence_gate(confidence_summary(questions, rows), floor, least).select("query_id", "level")
    out = questions.select("query_id", "question").join(level, "query_id")
    for part in (listed, counted, graph_context):
        out = out.join(part, "query_id", "left")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("sources", "graph_context")}
    out = out.withColumns({**texts, **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_sources", "n_facts")}})
    return out.select("query_id", "question", "sources", "total_sources", "level", "graph_context", "n_facts")


def batch_ask(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``retrieve`` of the questions that can be asked, and one row with an ``error`` for each of the others.

    A question that is null or has no letter or digit is not passed on, so that it fails alone; one that ``retrieve``
    (questions to rows with ``query_id`` and ``total_sources``) finds nothing for has an error as well.
    """
    empty = F.size(tokens(F.coalesce("question", F.lit("")))) == 0
    found = retrieve(questions.where(~empty))
    error = F.when(empty, "empty question").when(F.coalesce("total_sources", F.lit(0)) == 0, "no sources")
    return questions.join(found.drop("question"), "query_id", "left").withColumn("error", error)


def batch_totals(asked: DataFrame) -> DataFrame:
    """One row: questions asked, answered and failed."""
    return asked.agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
