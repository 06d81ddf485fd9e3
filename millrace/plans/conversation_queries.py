"""Registered queries over conversations, feedback, cache and event logs."""

from pyspark.sql import functions as F

from millrace.functions.text import cache_key
from millrace.operators import conversations as V
from millrace.plans.registry import query, table
from millrace.sources.scratch import shared_dir
from millrace.streaming.cache import ANSWERED, stream_cached_answers
from millrace.streaming.streams import ANSWER, log_windows, rollup_stream_events, stream_answers

# Conversations belong to user conv_id % 7. Feedback comes from events: message (conv_id, turn) by the event's number.
CONV_SQL = "convs AS (SELECT DISTINCT conv_id, conv_id % 7 AS user_id, concat('talk ', conv_id) AS title FROM conversations)"
FEEDBACK_SQL = """
    feedback AS (SELECT event_id, event_id % 120 AS conv_id, event_id % 6 AS turn, user_id % 5 AS user_id, CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' WHEN 'error' THEN NULL ELSE event_type END AS rating,
        repeat('r', (event_id % 600)::INT) AS reason, ts FROM events)
"""


def messages(spark, d):
    return table(spark, d, "conversations")


def convs(spark, d):
    rows = messages(spark, d).select("conv_id").distinct()
    return rows.withColumns({"user_id": F.col("conv_id") % 7, "title": F.concat(F.lit("talk "), F.col("conv_id").cast("string"))})


def feedback(spark, d):
    kind = F.col("event_type")
    rating = F.when(kind == "click", "up").when(kind == "view", "down").when(kind != "error", kind)
    return table(spark, d, "events").select(
        "event_id",
        (F.col("event_id") % 120).alias("conv_id"),
        (F.col("event_id") % 6).alias("turn"),
        (F.col("user_id") % 5).alias("user_id"),
        rating.alias("rating"),
        F.repeat(F.lit("r"), (F.col("event_id") % 600).cast("int")).alias("reason"),
        "ts",
    )


@query(
    "g1_conversation_list",
    f"WITH {CONV_SQL} SELECT c.conv_id, user_id, title, count(m.turn) AS message_count, max_by(m.text, m.turn) AS last_message FROM convs c LEFT JOIN conversations m USING (conv_id) GROUP BY ALL",
)
def g1(spark, d):
    return V.conversation_list(convs(spark, d), messages(spark, d))


@query(
    "g2_recent_messages",
    "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)",
)
def g2(spark, d):
    return V.recent_messages(messages(spark, d))


@query("g3_owned_conversation", f"WITH {CONV_SQL} SELECT * FROM convs WHERE user_id = conv_id % 2")
def g3(spark, d):
    rows = convs(spark, d)
    asked = rows.select("conv_id", (F.col("conv_id") % 2).alias("user_id"))
    return V.owned_conversation(rows, asked).select("conv_id", "user_id", "title")


_CHANGES_SQL = """
    changes AS (SELECT event_id % 200 AS conv_id, event_id + 1 AS seq, CASE event_type WHEN 'click' THEN 'rename' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' ELSE 'message' END AS op,
        concat('title ', event_id) AS title, concat('text ', event_id) AS text FROM events)
"""


@query(
    "g4_apply_conversation_changes",
    f"""
    WITH {CONV_SQL}, {FEEDBACK_SQL}, {_CHANGES_SQL}, e AS (SELECT conv_id, max(seq) AS last, coalesce(max(seq) FILTER (WHERE op = 'delete'), -1) AS deleted FROM changes GROUP BY 1),
    t AS (SELECT conv_id, title, 0 AS seq FROM convs UNION ALL SELECT conv_id, title, seq FROM changes WHERE op IN ('create', 'rename')),
    n AS (SELECT conv_id, max_by(title, seq) AS title FROM t GROUP BY 1),
    c AS (SELECT n.conv_id, n.title, coalesce(e.last, 0) AS updated_seq, coalesce(deleted, -2) AS deleted FROM n LEFT JOIN e USING (conv_id) WHERE deleted IS NULL OR deleted < last),
    m AS (SELECT conv_id, 0 AS s, turn, role FROM conversations UNION ALL SELECT conv_id, seq, seq + 1000000, CASE op WHEN 'create' THEN 'assistant' ELSE 'user' END FROM changes WHERE op IN ('message', 'create')),
    kept AS (SELECT c.conv_id, m.turn, m.role FROM c JOIN m ON m.conv_id = c.conv_id AND m.s > c.deleted),
    fb AS (SELECT f.conv_id, count(*) AS n FROM feedback f SEMI JOIN kept k ON k.conv_id = f.conv_id AND k.turn = f.turn GROUP BY 1)
    SELECT c.conv_id, c.title, c.updated_seq, (SELECT count(*) FROM kept k WHERE k.conv_id = c.conv_id) AS n_messages,
        (SELECT count(*) FROM kept k WHERE k.conv_id = c.conv_id AND turn > 1000000 AND role = 'assistant') AS n_greetings, coalesce(fb.n, 0) AS n_feedback FROM c LEFT JOIN fb USING (conv_id)
    """,
)
def g4(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "click", "rename").when(kind == "signup", "create").when(kind == "purchase", "delete").otherwise("message")
    number = F.col("event_id").cast("string")
    changes = table(spark, d, "events").select(
        (F.col("event_id") % 200).alias("conv_id"),
        (F.col("event_id") + 1).alias("seq"),
        op.alias("op"),
        F.concat(F.lit("title "), number).alias("title"),
        F.concat(F.lit("text "), number).alias("text"),
    )
    changed, kept, rated = V.apply_conversation_changes(
        convs(spark, d), messages(spark, d), feedback(spark, d), changes, greeting="Welcome."
    )
    greeted = F.count_if((F.col("text") == "Welcome.") & (F.col("role") == "assistant"))
    counted = kept.groupBy("conv_id").agg(F.count("*").alias("n_messages"), greeted.alias("n_greetings"))
    out = changed.join(counted, "conv_id", "left").join(rated.groupBy("conv_id").agg(F.count("*").alias("n_feedback")), "conv_id", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_messages", "n_greetings", "n_feedback")]
    return out.select("conv_id", "title", "updated_seq", *numbers)


@query(
    "g5_upsert_feedback",
    f"WITH {FEEDBACK_SQL} SELECT conv_id, turn, user_id, rating, length(reason) AS n_reason FROM feedback QUALIFY row_number() OVER (PARTITION BY conv_id, turn, user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def g5(spark, d):
    rows = V.upsert_feedback(feedback(spark, d))
    return rows.select("conv_id", "turn", "user_id", "rating", F.length("reason").cast("long").alias("n_reason"))


@query(
    "g6_feedback_for_messages",
    f"""
    WITH {FEEDBACK_SQL}, u AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY conv_id, turn, user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT m.conv_id, m.turn, m.role, u.rating FROM conversations m LEFT JOIN u ON u.conv_id = m.conv_id AND u.turn = m.turn AND u.user_id = 3
    """,
)
def g6(spark, d):
    rows = messages(spark, d).select("conv_id", "turn", "role")
    return V.feedback_for_messages(rows, V.upsert_feedback(feedback(spark, d)), 3)


@query(
    "g7_validate_feedback",
    f"""
    WITH {FEEDBACK_SQL} SELECT f.event_id, CASE WHEN rating IS NULL OR rating NOT IN ('up', 'down') THEN 'rating' WHEN length(reason) > 500 THEN 'reason too long'
        WHEN m.role IS NULL THEN 'no such message' WHEN m.role <> 'assistant' THEN 'not an answer' END AS reject
    FROM feedback f LEFT JOIN conversations m ON m.conv_id = f.conv_id AND m.turn = f.turn
    """,
)
def g7(spark, d):
    return V.validate_feedback(feedback(spark, d), messages(spark, d)).select("event_id", "reject")


@query(
    "g8_parse_citations",
    """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('1:', role, ',2:x') WHEN 1 THEN concat(turn, ':', role) END AS citations FROM conversations
    """,
)
def g8(spark, d):
    turn = F.col("turn")
    raw = (
        F.when(turn % 4 == 0, F.concat(F.lit('[{"index": 1, "source": "'), "role", F.lit('"}, {"index": 2, "source": "x"}]')))
        .when(turn % 4 == 1, F.concat(F.lit('{"index": '), turn.cast("string"), F.lit(', "source": "'), "role", F.lit('"}')))
        .when(turn % 4 == 2, "{oops")
    )
    parsed = V.parse_citations(raw)
    text = F.array_join(F.transform(parsed, lambda c: F.concat_ws(":", c["index"].cast("string"), c["source"])), ",")
    return messages(spark, d).select("conv_id", "turn", text.alias("citations"))


@query(
    "g9_pipeline_status",
    "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM lineitem) AS relations",
)
def g9(spark, d):
    names = {"documents": "documents", "vectors": "embeddings", "nodes": "customer", "relations": "lineitem"}
    return V.pipeline_status(**{k: table(spark, d, v) for k, v in names.items()})


@query("g10_cache_key", "SELECT conv_id, turn, concat('answer:', sha256(lower(trim(text)))[1:16]) AS key FROM conversations")
def g10(spark, d):
    return messages(spark, d).select("conv_id", "turn", cache_key(F.col("text")).alias("key"))


_LOOKUPS_SQL = """
    answers AS (SELECT concat('answer:', sha256(lower(trim(c.text)))[1:16]) AS key, concat('a', e.event_id) AS response, e.ts AS created_at FROM events e JOIN conversations c ON c.conv_id = e.event_id % 120 AND c.turn = e.event_id % 6),
    newest AS (SELECT key, max_by(response, (created_at, response)) AS response, max(created_at) AS created_at FROM answers GROUP BY 1),
    asked AS (SELECT conv_id * 100 + turn AS query_id, text AS question, turn < 3 AS standalone, concat('answer:', sha256(lower(trim(text)))[1:16]) AS key FROM conversations WHERE role = 'user'),
    lookups AS (SELECT query_id, question, a.key, coalesce(standalone AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(n.created_at) < 86400000000, false) AS hit, response FROM asked a LEFT JOIN newest n USING (key))
"""


def cache_inputs(spark, d):
    told = table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 120).alias("conv_id"), (F.col("event_id") % 6).alias("turn"))
    answers = told.join(messages(spark, d), ["conv_id", "turn"]).select(
        cache_key(F.col("text")).alias("key"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("response"), F.col("ts").alias("created_at")
    )
    asked = messages(spark, d).where("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"), (F.col("turn") < 3).alias("standalone")
    )
    return asked, answers


def lookups(spark, d):
    return V.answer_cache_lookup(*cache_inputs(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"), 86_400)


@query("g11_answer_cache_lookup", f"WITH {_LOOKUPS_SQL} SELECT query_id, question, key, CASE WHEN hit THEN response END AS response, hit FROM lookups")
def g11(spark, d):
    return lookups(spark, d).drop("standalone")


# What missed is answered and written back; the same questions asked again then find it.
@query(
    "g11_answer_cache_write_back",
    f"""
    WITH {_LOOKUPS_SQL}, s AS (SELECT l.*, a.standalone FROM lookups l JOIN asked a USING (query_id)),
    missed AS (SELECT key, concat('new ', min(query_id)) AS response FROM s WHERE standalone AND NOT hit GROUP BY 1)
    SELECT s.query_id, s.key, CASE WHEN s.hit THEN s.response WHEN s.standalone THEN m.response END AS response, s.standalone AS hit FROM s LEFT JOIN missed m USING (key)
    """,
)
def g11_back(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    asked, answers = cache_inputs(spark, d)
    first = V.answer_cache_lookup(asked, answers, now, 86_400)
    fresh = first.where("NOT hit").select("query_id", F.concat(F.lit("new "), F.col("query_id").cast("string")).alias("response"))
    cache = V.answer_cache_write_back(first, fresh, answers, now)
    return V.answer_cache_lookup(asked, cache, now, 86_400).select("query_id", "key", "response", "hit")


@query(
    "g12_embedding_dedupe",
    "SELECT doc_id, sha256(lower(trim(text)))[1:12] AS embedded FROM documents",
)
def g12(spark, d):
    def embed(rows):
        return rows.withColumn("embedded", F.substring("key", 1, 12))

    return V.embedding_dedupe(table(spark, d, "documents"), embed)


@query(
    "g13_cache_stats",
    f"WITH {_LOOKUPS_SQL}, k AS (SELECT * FROM lookups WHERE NOT starts_with(key, 'answer:0')) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, format('{{:.1f}}%', 100.0 * count(*) FILTER (WHERE hit) / count(*)) AS hit_rate FROM k",
)
def g13(spark, d):
    return V.cache_stats(V.invalidate(lookups(spark, d), "answer:0"))


@query(
    "i2_log_windows",
    "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1, 2",
)
def i2(spark, d):
    rows = log_windows(table(spark, d, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_ms", 6).alias("mean_ms"))


@query(
    "i2_stream_log_windows",
    "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1, 2",
)
def i2_stream(spark, d):
    """The log as a stream; one event a year later moves the watermark past every window but its own."""
    rows = table(spark, d, "events").select("event_type", "ts", "value")
    end = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit("end").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 366 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
    folder = shared_dir(spark, "log")
    for part in (rows, end):
        part.write.mode("append").parquet(f"{folder}/in")
        windows = log_windows(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        sink = windows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        sink.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    out = spark.read.schema(windows.schema).parquet(f"{folder}/out").where("event_type <> 'end'")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_ms", 6).alias("mean_ms"))


@query(
    "i3_rollup_stream_events",
    """
    WITH s AS (SELECT concat('u', user_id, '-', dayofyear(ts)) AS request_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'chunk' WHEN 'signup' THEN 'metadata' WHEN 'purchase' THEN 'citations' ELSE
        CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'confidence' END END AS type, concat('t', event_id % 100, ' ') AS data FROM events)
    SELECT request_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type = 'chunk'), '') AS answer, min_by(data, seq) FILTER (WHERE type = 'metadata') AS metadata, min_by(data, seq) FILTER (WHERE type = 'confidence') AS confidence,
        max_by(data, seq) FILTER (WHERE type = 'citations') AS citations, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000)::BIGINT AS total_ms, count(*) FILTER (WHERE type = 'chunk') AS tokens,
        CASE WHEN bool_or(type = 'done') THEN 'done' ELSE 'open' END AS status FROM s GROUP BY 1
    """,
)
def i3(spark, d):
    kind, number = F.col("event_type"), F.col("event_id")
    mapped = (
        F.when(kind.isin("click", "view"), "chunk")
        .when(kind == "signup", "metadata")
        .when(kind == "purchase", "citations")
        .when(number % 2 == 0, "done")
        .otherwise("confidence")
    )
    request = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.dayofyear("ts").cast("string"))
    events = table(spark, d, "events").select(
        request.alias("request_id"), number.alias("seq"), "ts", mapped.alias("type"), F.concat(F.lit("t"), (number % 100).cast("string"), F.lit(" ")).alias("data")
    )
    return rollup_stream_events(events)


@query(
    "i3_stream_answers",
    """
    WITH s AS (SELECT concat('u', user_id, '-', dayofyear(ts)) AS request_id, event_id AS seq, ts, concat('t', event_id % 100, ' ') AS data,
            CASE WHEN user_id % 5 > 0 AND event_id = max(event_id) OVER (PARTITION BY user_id, dayofyear(ts)) THEN 'done'
            ELSE CASE event_type WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'chunk' WHEN 'signup' THEN 'metadata' WHEN 'purchase' THEN 'citations' ELSE 'confidence' END END AS type FROM events)
    SELECT request_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type = 'chunk'), '') AS answer, min_by(data, seq) FILTER (WHERE type = 'metadata') AS metadata, min_by(data, seq) FILTER (WHERE type = 'confidence') AS confidence,
        max_by(data, seq) FILTER (WHERE type = 'citations') AS citations, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000)::BIGINT AS total_ms, count(*) FILTER (WHERE type = 'chunk') AS tokens,
        CASE WHEN bool_or(type = 'done') THEN 'done' ELSE 'open' END AS status, 0::BIGINT AS late FROM s GROUP BY 1
    """,
)
def i3_stream(spark, d):
    """The stream of answer events: a request's last event ends it, but for those of every fifth user, which time out.

    Events arrive in two halves by day; one event a year later moves the watermark past all others.
    """
    rows = table(spark, d, "events").withColumn("day", F.dayofyear("ts"))
    last = rows.groupBy("user_id", "day").agg(F.max("event_id").alias("event_id")).where("user_id % 5 > 0").withColumn("last", F.lit(True))
    kind = F.col("event_type")
    kinds = F.when(kind.isin("click", "view"), "chunk").when(kind == "signup", "metadata").when(kind == "purchase", "citations").otherwise("confidence")
    events = rows.join(last, ["user_id", "day", "event_id"], "left").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")).alias("request_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("last"), "done").otherwise(kinds).alias("type"),
        F.concat(F.lit("t"), (F.col("event_id") % 100).cast("string"), F.lit(" ")).alias("data"),
        "day",
    )
    middle = rows.agg(F.percentile_approx("day", 0.5)).first()[0] or 0
    end = rows.agg(F.max("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    end = end.select(F.lit("end").alias("request_id"), F.lit(0).cast("long").alias("seq"), (F.col("ts") + F.expr("INTERVAL 366 DAYS")).alias("ts"), F.lit("done").alias("type"), F.lit("").alias("data"))
    folder = shared_dir(spark, "answers")
    for part in (events.where(F.col("day") <= middle), events.where(F.col("day") > middle), end):
        part.select("request_id", "seq", "ts", "type", "data").write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema("request_id string, seq long, ts timestamp, type string, data string").parquet(f"{folder}/in")
        sink = stream_answers(arriving).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        sink.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(ANSWER).parquet(f"{folder}/out").where("request_id <> 'end'")


def _answers(asked):
    return [f"answer {i}" for i in asked["query_id"]]


# Questions of 150 wordings; an answer is good for three days from the question it was made for.
@query(
    "g11_stream_answer_cache",
    """
    WITH RECURSIVE q AS (SELECT event_id AS query_id, ts, event_id % 5 > 0 AS standalone, concat('answer:', sha256(lower(trim(concat(event_type, ' of ', user_id % 30))))[1:16]) AS key FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, query_id) AS n FROM q WHERE standalone),
    w AS (SELECT key, n, query_id, ts AS made, query_id AS owner, false AS hit FROM s WHERE n = 1
        UNION ALL SELECT s.key, s.n, s.query_id, CASE WHEN s.ts - made < INTERVAL 3 DAY THEN made ELSE s.ts END,
            CASE WHEN s.ts - made < INTERVAL 3 DAY THEN owner ELSE s.query_id END, s.ts - made < INTERVAL 3 DAY FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1)
    SELECT query_id, key, concat('answer ', owner) AS response, hit FROM w UNION ALL SELECT query_id, key, concat('answer ', query_id), false FROM q WHERE NOT standalone
    """,
)
def g11_stream(spark, d):
    """Questions arrive in two halves by time, every tenth of them twice."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("query_id"),
        F.concat(F.col("event_type"), F.lit(" of "), (F.col("user_id") % 30).cast("string")).alias("question"),
        (F.col("event_id") % 5 > 0).alias("standalone"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    folder, first = shared_dir(spark, "questions"), F.unix_micros("ts") <= middle
    for part in (rows.where(first), rows.where(~first)):
        part.unionByName(part.where("query_id % 10 = 0")).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        sink = stream_cached_answers(arriving, _answers, 3 * 86_400).writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(ANSWERED).parquet(f"{folder}/out")
