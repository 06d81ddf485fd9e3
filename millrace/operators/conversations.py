"""Conversations, messages, feedback, query log and answer cache as tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import cache_key

CITATION = "index bigint, source string"


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its number of messages and last message; conversations without messages stay."""
    counted = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max_by("text", "turn").alias("last_message"))
    out = conversations.join(counted, "conv_id", "left")
    return out.withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("long"))


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The newest ``n`` messages of each conversation, numbered oldest first."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("_r", newest).where(F.col("_r") <= n)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_r")))
    return kept.withColumn("place", place.cast("long")).drop("_r")


def owned_conversation(conversations: DataFrame, owners: DataFrame) -> DataFrame:
    """Conversations whose (conv_id, user_id) is asked for."""
    return conversations.join(owners.select("conv_id", "user_id").distinct(), ["conv_id", "user_id"], "left_semi")


def apply_conversation_changes(
    conversations: DataFrame, messages: DataFrame, feedback: DataFrame, changes: DataFrame, greeting: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold a change log into conversations, messages and feedback.

    ``changes(conv_id, seq, op, title, text)`` with op create, rename, message or delete. The last create or rename
    gives the title; a delete after everything else removes the conversation and cascades to messages and feedback;
    ``updated_seq`` is the last change that counts. Conversations of the table have sequence 0. With ``greeting`` every
    create adds it as a message of the assistant.
    """
    ended = changes.groupBy("conv_id").agg(
        F.max("seq").alias("last"), F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))), F.lit(-1)).alias("deleted")
    )
    base = conversations.select("conv_id", "title", F.lit(0).cast("long").alias("seq"))
    titled = base.unionByName(changes.where("op IN ('create', 'rename')").select("conv_id", "title", "seq"))
    named = titled.groupBy("conv_id").agg(F.max_by("title", "seq").alias("title"), F.max("seq").alias("named"))
    rows = named.join(ended, "conv_id", "left")
    alive = F.col("deleted").isNull() | (F.col("deleted") < F.col("last"))
    convs = rows.where(alive).select("conv_id", "title", F.coalesce("last", F.lit(0)).cast("long").alias("updated_seq"))
    gone = ended.select("conv_id", "deleted")
    added = changes.where("op = 'message'").select("conv_id", F.col("seq").alias("turn"), F.lit("user").alias("role"), "text")
    if greeting is not None:
        created = changes.where("op = 'create'").select("conv_id", F.col("seq").alias("turn"))
        added = added.unionByName(created.select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit(greeting).alias("text")))
    old = messages.select("conv_id", F.lit(0).cast("long").alias("_s"), "turn", "role", "text")
    everything = old.unionByName(added.select("conv_id", F.col("turn").alias("_s"), (F.col("turn") + 1_000_000).alias("turn"), "role", "text"))
    kept = everything.join(gone, "conv_id", "left").where(F.col("deleted").isNull() | (F.col("_s") > F.col("deleted")))
    msgs = kept.select("conv_id", "turn", "role", "text").join(convs.select("conv_id"), "conv_id", "left_semi")
    notes = feedback.join(msgs.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return convs, msgs, notes


def upsert_feedback(feedback: DataFrame) -> DataFrame:
    """The last rating of each user for each message: a pre-aggregated maximum."""
    newest = feedback.groupBy("conv_id", "turn", "user_id").agg(F.max(F.struct("ts", "event_id", "rating", "reason")).alias("f"))
    return newest.select("conv_id", "turn", "user_id", "f.rating", "f.reason", "f.ts")


def feedback_for_messages(messages: DataFrame, feedback: DataFrame, user_id: int) -> DataFrame:
    """All messages with one user's rating; unrated ones have null."""
    own = feedback.where(F.col("user_id") == user_id).select("conv_id", "turn", "rating")
    return messages.join(own, ["conv_id", "turn"], "left")


def validate_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``reject``: why a row is not acceptable, null where it is."""
    known = messages.select("conv_id", "turn", "role")
    rows = feedback.join(known, ["conv_id", "turn"], "left")
    reject = (
        F.when(~F.col("rating").isin("up", "down") | F.col("rating").isNull(), "rating")
        .when(F.length("reason") > 500, "reason too long")
        .when(F.col("role").isNull(), "no such message")
        .when(F.col("role") != "assistant", "not an answer")
    )
    return rows.withColumn("reject", reject)


def parse_citations(raw: Column) -> Column:
    """A JSON list of citations; a single object becomes a list of one; malformed text gives null."""
    listed = F.from_json(raw, f"array<struct<{', '.join(f'{n}:{t}' for n, t in (p.split() for p in CITATION.split(', ')))}>>")
    one = F.from_json(raw, CITATION)
    text = F.trim(raw)
    return F.when(text.startswith("["), listed).when(text.startswith("{") & one["index"].isNotNull(), F.array(one))


def pipeline_status(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, rows in tables.items():
        count = rows.agg(F.count("*").alias(name))
        out = count if out is None else out.join(count, F.lit(True))  # one row each
    return out


def answer_cache_lookup(questions: DataFrame, answers: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Each question with its cache key, the newest cached answer that is not too old, and whether there is one.

    Only standalone questions (those without history) use the cache.
    """
    newest = answers.groupBy("key").agg(F.max(F.struct("created_at", "response")).alias("a"))
    rows = questions.withColumn("key", cache_key(F.col("question"))).join(newest, "key", "left")
    fresh = (F.unix_micros(now) - F.unix_micros(F.col("a.created_at").cast("timestamp"))) < ttl_seconds * 1_000_000
    hit = F.coalesce(F.col("standalone") & fresh, F.lit(False))
    return rows.select("query_id", "question", "standalone", "key", F.when(hit, F.col("a.response")).alias("response"), hit.alias("hit"))


def answer_cache_write_back(lookups: DataFrame, fresh: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """The cache with the answers that missed: ``answers`` and, for each key of a standalone question that missed, one fresh one.

    ``lookups`` come from :func:`answer_cache_lookup` with their ``standalone`` column, ``fresh(query_id, response)`` are the
    answers given to what missed. Of several questions of one key the smallest ``query_id`` gives the answer.
    """
    missed = lookups.where("standalone AND NOT hit").join(fresh.select("query_id", F.col("response").alias("_r")), "query_id")
    rows = missed.groupBy("key").agg(F.min_by("_r", "query_id").alias("response")).withColumn("created_at", now)
    return answers.select("key", "response", "created_at").unionByName(rows.select("key", "response", "created_at"))


def embedding_dedupe(texts: DataFrame, embed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Embed each distinct normalised text once and join the result back to every row.

    ``embed`` adds columns to rows ``(key, text)``. The distinct step is pre-aggregated, so copies travel once.
    """
    keyed = texts.select(id_col, F.sha2(F.lower(F.trim(F.col(text_col))).cast("binary"), 256).alias("key"), F.col(text_col).alias("text"))
    once = keyed.groupBy("key").agg(F.min("text").alias("text"))
    return keyed.select(id_col, "key").join(embed(once).drop("text"), "key").drop("key")


def invalidate(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(prefix))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate as text ("0%" without lookups)."""
    counted = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.format_string("%.1f%%", 100.0 * F.col("hits") / total)).otherwise("0%")
    return counted.withColumn("hit_rate", rate)
