"""Registered queries over chunking operators."""

from pyspark.sql import functions as F


from millrace.functions.text import words
from millrace.operators import chunking as C
from millrace.plans.ingest_queries import SQL_HTML, sql_windows
from millrace.plans.registry import query, table
from millrace.plans.text_queries import SQL_WORDS
from millrace.sources.scratch import spread, written
from millrace.sources.files import html_to_text

# Documents with generated chapters, headings and paragraph markers: every line that is not blank gets a heading or marker by
# its number. The same expression is written for Spark and for SQL.
NUMBERED_SQL = r"""
    SELECT doc_id, concat('BİRİNCİ BÖLÜM', chr(10), string_agg(line, chr(10) ORDER BY i), chr(10)) AS text FROM (
        SELECT doc_id, i, concat(CASE i % 12 WHEN 3 THEN concat('İKİNCİ BÖLÜM', chr(10)) ELSE '' END, CASE i % 6
            WHEN 0 THEN concat('1.', i + 1, ' ') WHEN 1 THEN concat('1.', i, '.', i, ' - ') WHEN 2 THEN concat('1.', i - 1, '.', i - 1, '.A ')
            WHEN 3 THEN concat('1.', i - 2, '.', i - 2, '.A-', i, ' ') WHEN 4 THEN concat('(', i, ') ') ELSE concat('(', i + 1, ') EK-', i % 4, '/A ') END, l) AS line
        FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i
              FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)))
    GROUP BY doc_id
"""


def numbered_documents(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def s(x):
        return x.cast("string")

    def mark(line, i):
        chapter = F.when(i % 12 == 3, "İKİNCİ BÖLÜM\n").otherwise("")
        head = (
            F.when(i % 6 == 0, F.concat(F.lit("1."), s(i + 1), F.lit(" ")))
            .when(i % 6 == 1, F.concat(F.lit("1."), s(i), F.lit("."), s(i), F.lit(" - ")))
            .when(i % 6 == 2, F.concat(F.lit("1."), s(i - 1), F.lit("."), s(i - 1), F.lit(".A ")))
            .when(i % 6 == 3, F.concat(F.lit("1."), s(i - 2), F.lit("."), s(i - 2), F.lit(".A-"), s(i), F.lit(" ")))
            .when(i % 6 == 4, F.concat(F.lit("("), s(i), F.lit(") ")))
            .otherwise(F.concat(F.lit("("), s(i + 1), F.lit(") EK-"), s(i % 4), F.lit("/A ")))
        )
        return F.concat(chapter, head, line)

    docs = table(spark, d, "documents").where(F.size(lines) > 0)
    text = F.concat(F.lit("BİRİNCİ BÖLÜM\n"), F.array_join(F.transform(lines, mark), "\n"), F.lit("\n"))
    return written(spread(docs.select("doc_id", "text")).select("doc_id", text.alias("text")), "numbered", packed=True)  # made once, read by several operators


@query("c1_window_chunks", sql_windows("documents"))
def c1(spark, d):
    return C.window_chunks(table(spark, d, "documents"))


@query(
    "c2_sentence_group_chunks",
    r"""
    SELECT doc_id, i::BIGINT AS chunk_order, array_to_string(s[i * 5 + 1 : i * 5 + 5], '. ') AS chunk_text
    FROM (SELECT doc_id, s, unnest(range(ceil(len(s) / 5.0)::BIGINT)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'),
            lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents))
    """,
)
def c2(spark, d):
    return C.sentence_group_chunks(table(spark, d, "documents"))


@query("c3_extract_and_chunk", f"WITH p AS (SELECT page_id AS doc_id, {SQL_HTML} AS text FROM pages) {sql_windows('p')}")
def c3(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), html_to_text(F.col("html")).alias("text"))
    return C.window_chunks(pages)


_HEAD = r"(?m)^\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:\.[A-ZÇĞİÖŞÜ])?(?:-[0-9]+)?)\s*[-–]?\s*(.+?)$"
SECTIONS_SQL = rf"""
    n AS ({NUMBERED_SQL}),
    h AS (SELECT doc_id, text, regexp_extract_all(text, '{_HEAD}', 0) AS heads, regexp_split_to_array(text, '{_HEAD}') AS bodies FROM n),
    x AS (SELECT doc_id, unnest(heads) AS head, unnest(bodies[2:]) AS body, generate_subscripts(heads, 1) - 1 AS i, length(bodies[1]) AS lead FROM h),
    p AS (SELECT *, lead + coalesce(sum(length(head) + length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM x),
    s AS (SELECT doc_id, i::BIGINT AS index, regexp_extract(head, '{_HEAD}', 1) AS section_number, char_start::BIGINT AS char_start,
        regexp_replace(concat(head, body), '^\s+|\s+$', '', 'g') AS content, trim(regexp_replace(trim(regexp_extract(head, '{_HEAD}', 2)), '\([0-9]+\)', '', 'g')) AS own FROM p),
    sections AS (SELECT doc_id, index, section_number, char_start, content,
        len({SQL_WORDS.format('content')})::BIGINT AS word_count,
        last_value(own) OVER (PARTITION BY doc_id, section_number ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS section_title,
        CASE WHEN regexp_full_match(section_number, '[0-9]+\.[0-9]+\.[0-9]+\.[A-Z]-[0-9]+') THEN 5
             WHEN regexp_full_match(section_number, '[0-9]+\.[0-9]+\.[0-9]+\.[A-Z]') THEN 4
             WHEN regexp_full_match(section_number, '[0-9]+\.[0-9]+\.[0-9]+') THEN 3
             WHEN regexp_full_match(section_number, '[0-9]+\.[0-9]+') THEN 2 ELSE 0 END::BIGINT AS level FROM s)
"""


def sections(spark, d):
    return C.split_sections(numbered_documents(spark, d), cleaned=False)


def chaptered(spark, d, *columns):
    """Sections with their chapter and the given columns: the numbered documents are made once, the rows a written table."""
    docs = numbered_documents(spark, d)
    rows = C.chapter_as_of(C.split_sections(docs, cleaned=False), C.chapters(docs))
    return written(rows.select("doc_id", "index", "section_number", "section_title", "chapter", *columns), "chaptered", packed=True)


@query(
    "c4_split_sections",
    f"WITH {SECTIONS_SQL} SELECT doc_id, index, section_number, section_title, content, word_count, level, char_start FROM sections",
)
def c4(spark, d):
    return sections(spark, d)


@query("c5_section_level", f"WITH {SECTIONS_SQL} SELECT level, count(*) AS n, min(section_number) AS least FROM sections GROUP BY level")
def c5(spark, d):
    level = C.section_level(F.col("section_number")).cast("long")
    return sections(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("section_number").alias("least"))


@query(
    "c6_parent_chain",
    rf"""
    WITH {SECTIONS_SQL} SELECT doc_id, index, array_to_string(list_filter([
        CASE WHEN level >= 3 THEN regexp_extract(section_number, '^([0-9]+\.[0-9]+)\.', 1) END,
        CASE WHEN level >= 4 THEN regexp_extract(section_number, '^([0-9]+\.[0-9]+\.[0-9]+)\.', 1) END,
        CASE WHEN level = 5 THEN regexp_replace(section_number, '-[0-9]+$', '') END], lambda x: x IS NOT NULL), '>') AS chain FROM sections
    """,
)
def c6(spark, d):
    return sections(spark, d).select("doc_id", "index", F.array_join(C.parent_chain(F.col("section_number")), ">").alias("chain"))


@query(
    "c7_header_only",
    f"""
    WITH {SECTIONS_SQL}, m AS (SELECT *, lead(section_number) OVER (PARTITION BY doc_id ORDER BY index) AS nxt FROM sections)
    SELECT doc_id, index, coalesce(starts_with(nxt, concat(section_number, '.')) OR starts_with(nxt, concat(section_number, '-')), false) AS is_parent,
        word_count < 75 AND coalesce(starts_with(nxt, concat(section_number, '.')) OR starts_with(nxt, concat(section_number, '-')), false) AS header_only FROM m
    """,
)
def c7(spark, d):
    from pyspark.sql import Window

    following = F.lead("section_number").over(Window.partitionBy("doc_id").orderBy("index"))
    rows = sections(spark, d).withColumn("is_parent", C.is_parent(F.col("section_number"), following))
    return rows.select("doc_id", "index", "is_parent", ((F.col("word_count") < 75) & F.col("is_parent")).alias("header_only"))


CHAPTERED_SQL = rf"""
    {SECTIONS_SQL}, c AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '(BİRİNCİ|İKİNCİ) BÖLÜM', 0)) AS chapter, unnest(regexp_split_to_array(text, '(BİRİNCİ|İKİNCİ) BÖLÜM')[:-2]) AS before,
            generate_subscripts(regexp_extract_all(text, '(BİRİNCİ|İKİNCİ) BÖLÜM', 0), 1) AS i FROM n),
    q AS (SELECT doc_id, chapter, sum(length(before)) OVER w + coalesce(sum(length(chapter)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
          FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    chaptered AS (SELECT s.*, q.chapter FROM sections s ASOF LEFT JOIN q ON s.doc_id = q.doc_id AND s.char_start >= q.pos)
"""


@query("c8_chapter_as_of", f"WITH {CHAPTERED_SQL} SELECT doc_id, index, chapter FROM chaptered")
def c8(spark, d):
    docs = numbered_documents(spark, d)
    return C.chapter_as_of(C.split_sections(docs, cleaned=False), C.chapters(docs)).select("doc_id", "index", "chapter")


# Every second section is cut to its first few words, with a repeal note behind them.
@query(
    "c9_is_repealed",
    f"WITH {SECTIONS_SQL} SELECT doc_id, index, CASE WHEN index % 2 = 0 THEN least(index % 9, word_count) ELSE word_count END < 5 AS repealed FROM sections",
)
def c9(spark, d):
    few = F.array_join(F.slice(words(F.col("content")), F.lit(1), (F.col("index") % 9).cast("int")), " ")
    noted = F.concat(few, F.lit(" (Mülga:RG-1/1/2020-31000) (12)"))
    text = F.when(F.col("index") % 2 == 0, noted).otherwise(F.col("content"))
    return sections(spark, d).select("doc_id", "index", C.is_repealed(text).alias("repealed"))


# The fold over a document's sections, one place in all documents at a time: a section is in the group that ``start`` opened.
MERGED_SQL = rf"""
    cleaned AS (SELECT * REPLACE (len({SQL_WORDS.format('content')})::BIGINT AS word_count) FROM (SELECT * REPLACE (
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\((?:Değişik|Değişik ibare|Ek|Ek ibare|Mülga|Mülga ibare)[^)]+\)\s*(?:\([0-9]+\))?', '', 'g'),
            '(^|[^\n])\([0-9]{{2,3}}\)', '\1', 'g'), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content) FROM sections)),
    w AS (SELECT *, len({SQL_WORDS.format(r"regexp_replace(content, '\((?:Mülga)[^)]+\)\s*(?:\([0-9]+\))?', '', 'g')")}) < 5 OR (word_count < 75 AND coalesce(
        starts_with(nxt, concat(section_number, '.')) OR starts_with(nxt, concat(section_number, '-')), false)) AS dropped
        FROM (SELECT *, lead(section_number) OVER (PARTITION BY doc_id ORDER BY index) AS nxt FROM cleaned)),
    fold(doc_id, i, start, total) AS (
        SELECT doc_id, index, CASE WHEN NOT dropped THEN index END, word_count FROM w WHERE index = 0
        UNION ALL SELECT w.doc_id, w.index, CASE WHEN dropped THEN NULL WHEN start IS NOT NULL AND (total < 75 OR (word_count < 75 AND total + word_count <= 350)) THEN start ELSE w.index END,
            CASE WHEN start IS NOT NULL AND NOT dropped AND (total < 75 OR (word_count < 75 AND total + word_count <= 350)) THEN total + word_count ELSE word_count END
        FROM fold JOIN w ON w.doc_id = fold.doc_id AND w.index = i + 1),
    m AS (SELECT f.doc_id, f.start AS index, string_agg(content, concat(chr(10), chr(10)) ORDER BY i) AS content, count(*) > 1 AS is_merged, list(section_number ORDER BY i) AS numbers
        FROM fold f JOIN w ON w.doc_id = f.doc_id AND w.index = i WHERE start IS NOT NULL GROUP BY 1, 2),
    merged AS (SELECT m.doc_id, m.index, w.section_number, w.section_title, m.content, len({SQL_WORDS.format('m.content')})::BIGINT AS word_count, w.level, w.char_start, m.is_merged,
        CASE WHEN is_merged THEN numbers ELSE []::VARCHAR[] END AS merged_sections FROM m JOIN w ON w.doc_id = m.doc_id AND w.index = m.index)
"""


@query("c10_merge_small_sections", f"WITH RECURSIVE {SECTIONS_SQL}, {MERGED_SQL} SELECT * REPLACE (array_to_string(merged_sections, ',') AS merged_sections) FROM merged")
def c10(spark, d):
    rows = C.merge_small_sections(C.split_sections(numbered_documents(spark, d)))
    return rows.withColumn("merged_sections", F.array_join("merged_sections", ","))


def sql_headed(source: str) -> str:
    """``headed``: the rows of ``source`` with the chain of parents and the context header; titles come from ``sections``."""
    return rf"""
        t AS (SELECT doc_id, section_number, any_value(section_title) AS title FROM sections GROUP BY ALL),
        chains AS (SELECT doc_id, index, list_filter([
            CASE WHEN level >= 3 THEN regexp_extract(section_number, '^([0-9]+\.[0-9]+)\.', 1) END,
            CASE WHEN level >= 4 THEN regexp_extract(section_number, '^([0-9]+\.[0-9]+\.[0-9]+)\.', 1) END,
            CASE WHEN level = 5 THEN regexp_replace(section_number, '-[0-9]+$', '') END], lambda x: x IS NOT NULL) AS ps FROM {source}),
        chain AS (SELECT doc_id, index, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM chains),
        lines AS (SELECT c.doc_id, c.index, string_agg(concat('[', p, ': ', CASE WHEN length(title) > 60 THEN concat(title[1:60], '...') ELSE title END, ']'), chr(10) ORDER BY i) AS above
            FROM chain c JOIN t ON t.doc_id = c.doc_id AND t.section_number = c.p GROUP BY 1, 2),
        headed AS (SELECT s.*, array_to_string(ps, '>') AS parent_chain, concat_ws(chr(10), CASE WHEN chapter IS NOT NULL THEN concat('[BÖLÜM: ', chapter, ']') END, above,
            concat('[SECTION: ', section_number, ' - ', CASE WHEN length(section_title) > 60 THEN concat(section_title[1:60], '...') ELSE section_title END, ']')) AS context_header
            FROM {source} s JOIN chains k ON k.doc_id = s.doc_id AND k.index = s.index LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.index = s.index)
    """


@query("c11_context_header", f"WITH {CHAPTERED_SQL}, {sql_headed('chaptered')} SELECT doc_id, index, context_header FROM headed")
def c11(spark, d):
    rows = chaptered(spark, d)
    out = C.with_context_header(rows, rows.select("doc_id", "section_number", "section_title"))
    return out.select("doc_id", "index", "context_header")


def sql_fold(parts: str, most: str) -> str:
    """A list of strings packed in order to groups of at most ``most`` words."""
    start = f"list_transform({parts}, lambda y: {{'done': []::VARCHAR[], 'cur': y, 'n': len({SQL_WORDS.format('y')})}})"
    return f"""list_reduce({start}, lambda a, b: CASE WHEN a.n + b.n > {most} THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}}
        ELSE {{'done': a.done, 'cur': concat(a.cur, ' ', b.cur), 'n': a.n + b.n}} END)"""


def sql_chunked(most: int) -> str:
    """``chunked``: ``headed`` sections whole if they fit, else by paragraph, else by sentence."""
    marker = r"(?m)^\s*\([0-9]+\)\s"
    sentences = r"string_split(regexp_replace(t, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"
    return rf"""
        b AS (SELECT *, {most} - len({SQL_WORDS.format('context_header')}) - 5 AS budget, concat(chr(10), content) AS body FROM headed),
        ps AS (SELECT doc_id, index, budget - 2 AS budget, unnest(nums) AS fikra, regexp_replace(concat(unnest(heads), unnest(bodies[2:])), '^\s+|\s+$', '', 'g') AS t, generate_subscripts(nums, 1) AS pi
            FROM (SELECT *, regexp_extract_all(body, '(?m)^\s*\(([0-9]+)\)\s', 1) AS nums, regexp_extract_all(body, '{marker}', 0) AS heads, regexp_split_to_array(body, '{marker}') AS bodies
                FROM b WHERE word_count > budget)),
        long AS (SELECT doc_id, index, budget, fikra, t, pi FROM ps WHERE len({SQL_WORDS.format('t')}) > budget UNION ALL
            SELECT doc_id, index, budget, NULL, content, 0 FROM b WHERE word_count > budget AND NOT regexp_matches(body, '{marker}')),
        cut AS (SELECT doc_id, index, fikra, pi, list_append(r.done, r.cur) AS g FROM (SELECT *, {sql_fold(sentences, 'budget')} AS r FROM long)),
        pieces AS (SELECT doc_id, index, 0 AS pi, 0 AS chunk_index, content AS t, NULL AS fikra, CASE WHEN is_merged THEN 'merged_section' ELSE 'full_section' END AS chunk_type FROM b WHERE word_count <= budget
            UNION ALL SELECT doc_id, index, pi, 0, t, fikra, 'fikra' FROM ps WHERE len({SQL_WORDS.format('t')}) <= budget
            UNION ALL SELECT doc_id, index, pi, generate_subscripts(g, 1) - 1, unnest(g), fikra, 'sentence_split' FROM cut),
        chunked AS (SELECT p.doc_id, p.index, row_number() OVER (PARTITION BY p.doc_id, p.index ORDER BY pi, chunk_index) - 1 AS part, p.t AS chunk_text,
            CASE WHEN fikra IS NOT NULL THEN concat(context_header, chr(10), '[FIKRA: (', fikra, ')]') ELSE context_header END AS context_header, len({SQL_WORDS.format('p.t')})::BIGINT AS word_count,
            section_number, section_title, level, parent_chain, chapter, fikra, chunk_type, chunk_index::BIGINT AS chunk_index, is_merged AND ends_with(chunk_type, 'section') AS is_merged,
            CASE WHEN ends_with(chunk_type, 'section') THEN array_to_string(merged_sections, ',') ELSE '' END AS merged_sections FROM pieces p JOIN b ON b.doc_id = p.doc_id AND b.index = p.index)
    """


@query(
    "c12_chunk_sections",
    f"""
    WITH {CHAPTERED_SQL}, plain AS (SELECT *, false AS is_merged, []::VARCHAR[] AS merged_sections FROM chaptered), {sql_headed('plain')}, {sql_chunked(60)}
    SELECT * FROM chunked
    """,
)
def c12(spark, d):
    rows = chaptered(spark, d, "char_start", "content", "word_count", "level")
    rows = rows.withColumn("is_merged", F.lit(False)).withColumn("merged_sections", F.array().cast("array<string>"))
    return _flat(C.chunk_sections(C.with_context_header(rows, rows.select("doc_id", "section_number", "section_title")), most=60))


def _flat(chunks):
    """Chunk rows with their lists as text."""
    lists = {"parent_chain": F.array_join("parent_chain", ">"), "merged_sections": F.array_join("merged_sections", ",")}
    return chunks.withColumns(lists)


@query(
    "c13_paragraph_split",
    rf"""
    WITH n AS ({NUMBERED_SQL}), m AS (SELECT doc_id, regexp_split_to_array(concat(chr(10), text), '(?m)^\s*\([0-9]+\)\s') AS bodies,
        regexp_extract_all(concat(chr(10), text), '(?m)^\s*\(([0-9]+)\)\s', 1) AS nums, regexp_extract_all(concat(chr(10), text), '(?m)^\s*\([0-9]+\)\s', 0) AS heads FROM n)
    SELECT doc_id, unnest(nums) AS fikra, regexp_replace(concat(unnest(heads), unnest(bodies[2:])), '^\s+|\s+$', '', 'g') AS text FROM m
    """,
)
def c13(spark, d):
    rows = numbered_documents(spark, d).select("doc_id", F.explode(C.split_paragraphs(F.col("text"))).alias("text"))
    return rows.select("doc_id", F.regexp_extract("text", C.PARAGRAPH_NUMBER, 1).alias("fikra"), "text")


def sql_packed(parts: str, size: str, most: int, joiner: str) -> str:
    """Documents' ``parts`` packed in order to groups of at most ``most`` by ``size`` (of ``y``), joined by ``joiner``."""
    return f"""
        SELECT doc_id, unnest(g) AS chunk_text, generate_subscripts(g, 1) - 1 AS chunk_order FROM (SELECT doc_id, list_append(r.done, r.cur) AS g FROM (
            SELECT doc_id, list_reduce(list_transform({parts}, lambda y: {{'done': []::VARCHAR[], 'cur': y, 'n': {size}}}), lambda a, b: CASE WHEN a.n + b.n > {most}
                THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}} ELSE {{'done': a.done, 'cur': concat(a.cur, '{joiner}', b.cur), 'n': a.n + b.n}} END) AS r FROM documents))
    """


SENTENCES_SQL = r"string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"


@query(
    "c14_pack_sentences",
    f"""
    WITH p AS ({sql_packed(SENTENCES_SQL, f"len({SQL_WORDS.format('y')})", 350, ' ')})
    SELECT doc_id, chunk_order, chunk_text, len({SQL_WORDS.format('chunk_text')})::BIGINT AS word_count FROM p
    """,
)
def c14(spark, d):
    return C.pack_sentences(table(spark, d, "documents"))


@query(
    "c15_finalize_chunks",
    f"""
    WITH c AS ({sql_windows('documents', 120, 30)})
    SELECT doc_id, chunk_text, word_count, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) - 1 AS chunk_order FROM c WHERE word_count >= 100
    """,
)
def c15(spark, d):
    rows = C.window_chunks(table(spark, d, "documents"), 120, 30)
    rows = rows.withColumn("index", F.col("chunk_order")).withColumn("part", F.lit(0)).drop("chunk_order")
    return C.finalize_chunks(rows, 100)


@query(
    "c16_no_heading_fallback",
    f"""
    SELECT doc_id, 0::BIGINT AS chunk_order, text AS chunk_text, '' AS context_header, len({SQL_WORDS.format('text')})::BIGINT AS word_count,
        '' AS section_number, 'Document' AS section_title, 0::BIGINT AS level
    FROM documents WHERE NOT regexp_matches(text, '{_HEAD}')
    """,
)
def c16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.no_heading_fallback(docs, C.split_sections(docs))


@query(
    "c17_chunk_statistics",
    f"""
    WITH {SECTIONS_SQL}, c AS (SELECT *, CASE WHEN word_count < 50 THEN 'small' ELSE 'large' END AS chunk_type FROM sections)
    SELECT count(*) AS total_chunks, sum(word_count)::BIGINT AS total_words, round(avg(word_count), 4) AS avg_words, min(word_count) AS min_words,
        max(word_count) AS max_words, count(DISTINCT section_number) AS sections_covered,
        (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT concat(level, ':', count(*)) AS e FROM c GROUP BY level)) AS by_level,
        (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT concat(chunk_type, ':', count(*)) AS e FROM c GROUP BY chunk_type)) AS by_chunk_type FROM c
    """,
)
def c17(spark, d):
    return C.chunk_statistics(sections(spark, d).withColumn("chunk_type", F.when(F.col("word_count") < 50, "small").otherwise("large")))


@query(
    "c18_text_for_llm",
    f"WITH {SECTIONS_SQL} SELECT doc_id, index, CASE WHEN level = 2 THEN content ELSE concat('[', section_title, ']', chr(10), chr(10), content) END AS text FROM sections",
)
def c18(spark, d):
    header = F.when(F.col("level") == 2, "").otherwise(F.concat(F.lit("["), "section_title", F.lit("]")))
    return sections(spark, d).select("doc_id", "index", C.text_for_llm(header, F.col("content")).alias("text"))


def sql_sub_chunks(source: str, keys: str) -> str:
    """CTE body of sub-chunks over ``source(<keys>, chunk_text)``."""
    return f"""
        SELECT {keys}, i::BIGINT AS sub_order, CASE WHEN len(w) <= 120 THEN chunk_text ELSE array_to_string(w[i * 90 + 1 : i * 90 + 120], ' ') END AS sub_text
        FROM (SELECT *, unnest(range(CASE WHEN len(w) <= 120 THEN 1 ELSE (len(w) - 20) // 90 + 1 END)) AS i
              FROM (SELECT *, {SQL_WORDS.format('chunk_text')} AS w FROM {source}))
    """


@query("c19_sub_chunks", f"WITH c AS ({sql_windows('documents')}) {sql_sub_chunks('c', 'doc_id, chunk_order')}")
def c19(spark, d):
    return C.sub_chunks(C.window_chunks(table(spark, d, "documents"))).select("doc_id", "chunk_order", "sub_order", "sub_text")


@query("c20_char_budget_chunks", sql_packed("string_split(replace(text, '. ', '.|'), '|')", "length(y)", 3000, ""))
def c20(spark, d):
    return C.char_budget_chunks(table(spark, d, "documents"))


@query(
    "c21_annex_references",
    rf"""
    WITH n AS ({NUMBERED_SQL}) SELECT doc_id, annex, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '(?i)EK[-\s]*([0-9]+(?:/[A-ZÇĞİÖŞÜ])?(?:-[0-9]+)?)', 1)) AS annex FROM n) GROUP BY 1, 2
    """,
)
def c21(spark, d):
    return C.annex_references(numbered_documents(spark, d))


@query(
    "c21_letter_items",
    """
    WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))
    SELECT doc_id, chr((97 + i % 5)::INTEGER) AS letter, count(*) AS n FROM l GROUP BY 1, 2
    """,
)
def c21_letters(spark, d):
    """Every line that is not blank gets a letter by its number."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marked = F.transform(lines, lambda x, i: F.concat(F.get(F.array(*[F.lit(c) for c in "abcde"]), i % 5), F.lit(") "), x))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))
    return C.letter_items(docs)


# All generated documents have headings, so the fallback has no rows in the SQL.
@query(
    "c22_structure_chunk_documents",
    f"""
    WITH RECURSIVE {CHAPTERED_SQL}, {MERGED_SQL}, units AS (SELECT m.*, q.chapter FROM merged m ASOF LEFT JOIN q ON m.doc_id = q.doc_id AND m.char_start >= q.pos),
    {sql_headed('units')}, {sql_chunked(350)}
    SELECT * EXCLUDE (index, part), row_number() OVER (PARTITION BY doc_id ORDER BY index, part) - 1 AS chunk_order FROM chunked
    """,
)
def c22(spark, d):
    return _flat(C.structure_chunk_documents(numbered_documents(spark, d)))
