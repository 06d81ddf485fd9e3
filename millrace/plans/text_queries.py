"""Registered queries over text expressions."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query, table
from millrace.sources.scratch import written

SQL_CLEAN = r"""trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[^\pL\pN_\s.,!?;:()\-–—"'']', '', 'g'))"""
SQL_NORMAL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_TYPOS = ", ".join(f"'{k}': '{v}'" for k, v in T.TYPO_CORRECTIONS.items())
SQL_FIX = "array_to_string(list_transform({0}, lambda w: coalesce(map_extract(MAP {{" + _TYPOS + "}}, lower(w))[1], w)), ' ')"
# Questions with misspelled words put in front, so that the dictionary has something to do.
_MISSPELT = "concat('Saglik  sigota\t' , text, ' RECETE ')"


@query("b1_normalize_whitespace", f"SELECT conv_id, turn, {SQL_NORMAL.format('text')} AS text FROM conversations")
def b1(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_whitespace(F.col("text")).alias("text"))


@query(
    "b2_fix_typos",
    f"SELECT conv_id, turn, {SQL_FIX.format(SQL_WORDS.format(_MISSPELT))} AS text FROM conversations",
)
def b2(spark, d):
    misspelt = F.concat(F.lit("Saglik  sigota\t"), F.col("text"), F.lit(" RECETE "))
    return table(spark, d, "conversations").select("conv_id", "turn", T.fix_typos(misspelt).alias("text"))


# Conversations' turns are told apart by a number of their own where a pair of them repeats.
@query("b2_fix_typos_by_table", f"SELECT conv_id, turn, {SQL_FIX.format(SQL_WORDS.format(_MISSPELT))} AS text FROM conversations")
def b2_table(spark, d):
    misspelt = F.concat(F.lit("Saglik  sigota\t"), F.col("text"), F.lit(" RECETE "))
    rows = written(table(spark, d, "conversations").select("conv_id", "turn", misspelt.alias("text"), F.monotonically_increasing_id().alias("row")), "turns")
    corrections = spark.createDataFrame([*T.TYPO_CORRECTIONS.items()], "wrong string, right string")
    return T.fix_typos_by_table(rows, corrections, ["row"]).select("conv_id", "turn", "text")


@query(
    "b3_preprocess",
    f"SELECT conv_id, turn, {SQL_FIX.format(SQL_WORDS.format(SQL_NORMAL.format(_MISSPELT)))} AS text FROM conversations",
)
def b3(spark, d):
    misspelt = F.concat(F.lit("Saglik  sigota\t"), F.col("text"), F.lit(" RECETE "))
    return table(spark, d, "conversations").select("conv_id", "turn", T.preprocess(misspelt).alias("text"))


@query("b4_clean_text", f"SELECT doc_id, {SQL_CLEAN.format('text')} AS text FROM documents")
def b4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


_NOTED = r"concat('1.1 Baş (Değişik:RG-25/8/2022-31934) (94)', chr(10), '(12) ', text, ' (128) son  (EK-2/F) (Ek-2) x')"


@query(
    "b5_clean_amendments",
    rf"""
    WITH n AS (SELECT doc_id, {_NOTED} AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(t, '\((?:Değişik|Değişik ibare|Ek|Ek ibare|Mülga|Mülga ibare)[^)]+\)\s*(?:\([0-9]+\))?', '', 'g') AS t FROM n),
    b AS (SELECT doc_id, regexp_replace(t, '(^|[^\n])\([0-9]{{2,3}}\)', '\1', 'g') AS t FROM a)
    SELECT doc_id, regexp_replace(regexp_replace(t, '  +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM b
    """,
)
def b5(spark, d):
    noted = F.concat(
        F.lit("1.1 Baş (Değişik:RG-25/8/2022-31934) (94)\n(12) "), F.col("text"), F.lit(" (128) son  (EK-2/F) (Ek-2) x")
    )
    return table(spark, d, "documents").select("doc_id", T.clean_amendments(noted).alias("text"))


@query(
    "b6_clean_title",
    r"""
    WITH n AS (SELECT p_partkey, concat(' ', p_name, ' (Değişik:RG-1) (Ek: x)(94) (Mülga:a) ') AS t FROM part)
    SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(t),
        '\(Değişik:.*?\)', '', 'g')), '\(Ek:.*?\)', '', 'g')), '\(Mülga:.*?\)', '', 'g')), '\([0-9]+\)', '', 'g')) AS title FROM n
    """,
)
def b6(spark, d):
    noted = F.concat(F.lit(" "), F.col("p_name"), F.lit(" (Değişik:RG-1) (Ek: x)(94) (Mülga:a) "))
    return table(spark, d, "part").select("p_partkey", T.clean_title(noted).alias("title"))


@query("b7_word_count", f"SELECT doc_id, len({SQL_WORDS.format('text')})::BIGINT AS n_words FROM documents")
def b7(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(
    "b8_apply_hedge",
    "SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN concat('"
    + T.HEDGE.replace("'", "''")
    + "', text) ELSE text END AS prompt FROM conversations WHERE role = 'user'",
)
def b8(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", T.apply_hedge(F.col("text"), F.length("text") < 60).alias("prompt"))


@query(
    "b9_truncate_preview",
    "SELECT doc_id, "
    + ", ".join(f"CASE WHEN length(text) > {n} THEN concat(text[1:{n}], '...') ELSE text END AS p{n}" for n in (100, 200, 1000))
    + ", round(n_chars / 7.0::DOUBLE, 4) AS score FROM documents",
)
def b9(spark, d):
    previews = [T.truncate_preview(F.col("text"), n).alias(f"p{n}") for n in (100, 200, 1000)]
    return table(spark, d, "documents").select("doc_id", *previews, F.round(F.col("n_chars") / 7.0, 4).alias("score"))


_MARKERS = r"""
    WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE
        concat(text, ' [', doc_id % 5, '][', doc_id % 7, '] [N] [12]') END AS answer FROM documents)
    SELECT doc_id, array_to_string(regexp_extract_all(answer, '\[([0-9]+)\]', 1), ',') AS markers,
        len(regexp_extract_all(answer, '\[([0-9]+)\]', 1)) > 0 AS has_markers FROM a
    """


@query("b10_citation_markers", _MARKERS)
@query("b10_citation_markers_whole", _MARKERS)
def b10(spark, d):
    five, seven = (F.col("doc_id") % 5).cast("string"), (F.col("doc_id") % 7).cast("string")
    marked = F.concat(F.col("text"), F.lit(" ["), five, F.lit("]["), seven, F.lit("] [N] [12]"))
    markers = T.citation_markers(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked))
    return table(spark, d, "documents").select(
        "doc_id",
        F.array_join(markers.cast("array<string>"), ",").alias("markers"),
        (F.size(markers) > 0).alias("has_markers"),
    )


@query(
    "b11_score_band",
    """
    SELECT CASE WHEN s IS NULL THEN 'none' WHEN s >= 4.5 THEN 'good' WHEN s >= 3.5 THEN 'fair' ELSE 'poor' END AS band,
        CASE WHEN r IS NULL THEN 'none' WHEN r >= 0.8 THEN 'high' WHEN r >= 0.5 THEN 'medium' WHEN r >= 0.1 THEN 'low' ELSE 'weak' END AS relevance,
        count(*) AS n
    FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 50) / 10.0 END AS s,
                 CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 101) / 100.0 END AS r FROM events) GROUP BY 1, 2
    """,
)
def b11(spark, d):
    event = F.col("event_id")
    score = F.when(event % 11 == 0, None).otherwise((event % 50) / 10.0)
    relevance = F.when(event % 13 == 0, None).otherwise((event % 101) / 100.0)
    rows = table(spark, d, "events").select(T.score_band(score).alias("band"), T.relevance_band(relevance).alias("relevance"))
    return rows.groupBy("band", "relevance").agg(F.count("*").alias("n"))


@query(
    "b12_relative_date_bucket",
    """
    WITH n AS (SELECT max(ts) AS now FROM events), e AS (
        SELECT ts, floor((epoch_us(now) - epoch_us(ts)) / 86400000000)::BIGINT AS days FROM events, n)
    SELECT CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN concat(days, ' days')
        WHEN days < 30 THEN concat(days // 7, ' weeks') ELSE strftime(ts, '%Y-%m-%d') END AS bucket, count(*) AS n
    FROM e GROUP BY 1
    """,
)
def b12(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.join(F.broadcast(now), F.lit(True))  # one row
    return rows.groupBy(T.relative_date_bucket(F.col("ts"), F.col("now")).alias("bucket")).agg(F.count("*").alias("n"))
