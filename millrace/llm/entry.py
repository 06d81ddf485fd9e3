"""The queries of this package: thin forms of its operators over the given tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    clustering,
    embedding_dedup,
    filter_audit,
    language_id,
    packing,
    piece_hashing,
    pii,
    quality,
    text_dedup,
    token_counts,
    token_files,
    toxicity,
)
from millrace.llm.piece_codec import encode_pieces

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs, language_id.fit_languages(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_files(_table(spark, sf_dir, "documents"), WORD_BPE)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(_table(spark, sf_dir, "documents"), PIECE_BPE)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dedup.near_duplicate_texts(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_digests(pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks, letters = filter_audit.failure_masks(_table(spark, sf_dir, "documents"))
    return filter_audit.audit_orders(filter_audit.mask_cells(masks, _table(spark, sf_dir, "labels")), letters)


def op12_piece_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_hashing.compare_with_next(_table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_piece_codec": op6_piece_codec,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_text_dedup": op8_text_dedup,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_piece_hashing": op12_piece_hashing,
    "op13_clustering": op13_clustering,
    "pipeline": pipeline,
}


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """All rounds of exact k-means as a chain of tables, every vector compared with every centroid."""
    steps = [
        """v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, e) - 1 AS cluster, e AS c
            FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h, e LIMIT {k})
        )""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT vec_id, e, min(struct_pack(distance, cluster)) AS m FROM (
                SELECT vec_id, e, c{i}.cluster, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
                FROM v, c{i}
            ) GROUP BY vec_id, e
        )""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT c{i}.cluster, coalesce(u.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
                    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                        SELECT m.cluster AS cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n
                        FROM a{i}, range(1, 65) r(i) GROUP BY m.cluster, i
                    ) GROUP BY cluster
                ) u ON u.cluster = c{i}.cluster
            )""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, m.cluster::INTEGER AS cluster, m.distance AS distance,
            sum(m.distance) OVER (PARTITION BY m.cluster)::BIGINT AS cluster_inertia, sum(m.distance) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = m.cluster"""

ORACLE_SQL: dict[str, str] = {
    # Exact counterparts; cosines of 64 float components, as in the operator, in double precision.
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT l.a AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, l.a = l.component_id AS kept
        FROM least l LEFT JOIN counted c ON c.a = l.a
    """,
    # Classes and links from all pairs that share a shingle, compared exactly.
    "op8_text_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM w WHERE len(w) > 0
        ), classes AS (
            SELECT min(doc_id) AS class_id, any_value(s) AS s, list(doc_id) AS docs FROM s GROUP BY md5(array_to_string(s, chr(10)))
        ), e AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM classes),
        links AS (
            SELECT a.class_id AS a, b.class_id AS b FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id
            GROUP BY 1, 2, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT class_id, class_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        found AS (SELECT unnest(docs) AS doc_id, class_id, component_id FROM classes JOIN least ON a = class_id)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(component_id, d.doc_id) AS component_id,
            coalesce(component_id, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
    """,
    # Failure masks by document, then every order of the letters, each step counted on its own.
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), marked AS (
            SELECT d.*, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d
        ), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
        cells AS (
            SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
                count(good.doc_id) AS good, count(toxic.doc_id) AS toxic
            FROM marked LEFT JOIN good ON good.doc_id = marked.doc_id LEFT JOIN toxic ON toxic.doc_id = marked.doc_id GROUP BY ALL
        ), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders(filter_order, applied, befores, bits) AS (
            SELECT '', 0, [0][1:0], [0][1:0] UNION ALL
            SELECT filter_order || letter, applied + bit, list_append(befores, applied), list_append(bits, bit)
            FROM orders, letters WHERE applied & bit = 0
        ), steps AS (
            SELECT filter_order, unnest(range(1, 6)) AS step, unnest(befores) AS before, unnest(bits) AS bit FROM orders WHERE applied = 31
        ), counted AS (
            SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
    """,
    # Every vector against every centroid, in whole numbers, round by round.
    "op13_clustering": _clustering_sql(),
}
