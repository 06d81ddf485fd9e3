"""Registered queries over the graph of customers, nations, regions, suppliers and parts."""

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.plans.registry import query, table
from millrace.sources.scratch import written

NODES_SQL = """
    nodes AS (SELECT c_name AS name, 'Customer' AS label FROM customer UNION ALL SELECT n_name, 'Nation' FROM nation
        UNION ALL SELECT r_name, 'Region' FROM region UNION ALL SELECT s_name, 'Supplier' FROM supplier
        UNION ALL SELECT concat('Part#', p_partkey), 'Part' FROM part)
"""
EDGES_SQL = """
    edges AS (SELECT c_name AS src, 'LIVES_IN' AS predicate, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'PART_OF', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT DISTINCT s_name, 'SUPPLIES', concat('Part#', l_partkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}, ways AS (SELECT src AS a, dst AS b, predicate AS rel, concat(src, '|', predicate, '|', dst) AS e FROM edges UNION ALL SELECT dst, src, predicate, concat(src, '|', predicate, '|', dst) FROM edges)"
SEEDS_SQL = "seeds AS (SELECT n_name AS seed FROM nation UNION ALL SELECT s_name FROM supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT c_name FROM customer WHERE c_custkey % 50 = 0)"
RELATED_SQL = f"""
    {GRAPH_SQL}, {SEEDS_SQL},
    one AS (SELECT seed, b AS entity, rel AS relation, e FROM seeds JOIN ways ON a = seed),
    rel AS (SELECT seed, entity, relation FROM one UNION SELECT seed, w.b, relation FROM one JOIN ways w ON w.a = one.entity AND w.e <> one.e),
    related AS (SELECT r.*, label FROM rel r LEFT JOIN nodes ON name = entity)
"""


def nodes(spark, d):
    def part(name, column, label):
        return table(spark, d, name).select(column.alias("name"), F.lit(label).alias("label"))

    out = part("customer", F.col("c_name"), "Customer").unionByName(part("nation", F.col("n_name"), "Nation"))
    out = out.unionByName(part("region", F.col("r_name"), "Region")).unionByName(part("supplier", F.col("s_name"), "Supplier"))
    return out.unionByName(part("part", F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")), "Part"))


def edges(spark, d):
    nation = table(spark, d, "nation")
    lives = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lives = lives.select(F.col("c_name").alias("src"), F.lit("LIVES_IN").alias("predicate"), F.col("n_name").alias("dst"))
    within = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    within = within.select(F.col("n_name").alias("src"), F.lit("PART_OF").alias("predicate"), F.col("r_name").alias("dst"))
    supplied = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    supplies = supplied.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("src"), F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("dst")
    )
    return lives.unionByName(within).unionByName(supplies)


def seeds(spark, d):
    out = table(spark, d, "nation").select(F.col("n_name").alias("seed"))
    out = out.unionByName(table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_name").alias("seed")))
    return out.unionByName(table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_name").alias("seed")))


# Model replies made from part: every third in a code fence, every fifth malformed, every seventh with an incomplete item.
REPLIES_SQL = """
    replies AS (SELECT p_partkey AS doc_id, concat(CASE WHEN p_partkey % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
        '{"triplets":[{"subject":"', p_name, '","predicate":"made by","object":"', p_brand, '"}',
        CASE WHEN p_partkey % 7 = 0 THEN ',{"subject":"x","predicate":"is"}' ELSE concat(',{"subject":"', upper(p_name), '","predicate":"MADE BY","object":"', p_brand, '"}') END,
        ',{"subject":"ab","predicate":"kind-of thing","object":"', p_type, '"}',
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ']}' END, CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) AS raw FROM part),
    parsed AS (SELECT p_partkey AS doc_id, 0::BIGINT AS pos, p_name AS subject, 'made by' AS predicate, p_brand AS object FROM part WHERE p_partkey % 5 > 0
        UNION ALL SELECT p_partkey, 1, upper(p_name), 'MADE BY', p_brand FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0
        UNION ALL SELECT p_partkey, 2, 'ab', 'kind-of thing', p_type FROM part WHERE p_partkey % 5 > 0)
"""


def replies(spark, d):
    key = F.col("p_partkey")
    fence = key % 3 == 0
    second = F.when(key % 7 == 0, ',{"subject":"x","predicate":"is"}').otherwise(
        F.concat(F.lit(',{"subject":"'), F.upper("p_name"), F.lit('","predicate":"MADE BY","object":"'), "p_brand", F.lit('"}'))
    )
    raw = F.concat(
        F.when(fence, "```json\n").otherwise(""),
        F.lit('{"triplets":[{"subject":"'),
        "p_name",
        F.lit('","predicate":"made by","object":"'),
        "p_brand",
        F.lit('"}'),
        second,
        F.lit(',{"subject":"ab","predicate":"kind-of thing","object":"'),
        "p_type",
        F.lit('"}'),
        F.when(key % 5 == 0, "").otherwise("]}"),
        F.when(fence, "\n```").otherwise(""),
    )
    return table(spark, d, "part").select(key.alias("doc_id"), raw.alias("raw"))


@query("e1_parse_triplets", f"WITH {REPLIES_SQL} SELECT doc_id, pos, subject, predicate, object FROM parsed")
def e1(spark, d):
    return G.parse_triplets(replies(spark, d))


@query(
    "e2_dedupe_triplets",
    f"WITH {REPLIES_SQL} SELECT doc_id, pos, subject, predicate, object FROM parsed QUALIFY row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY doc_id, pos) = 1",
)
def e2(spark, d):
    return G.dedupe_triplets(G.parse_triplets(replies(spark, d)), ["doc_id", "pos"])


@query(
    "e3_drop_short_entities",
    f"WITH {REPLIES_SQL} SELECT doc_id, count(*) AS n FROM parsed WHERE length(subject) > 2 AND length(object) > 2 GROUP BY 1",
)
def e3(spark, d):
    return G.drop_short_entities(G.parse_triplets(replies(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "e4_normalize_predicate",
    f"WITH {REPLIES_SQL} SELECT doc_id, pos, upper(replace(replace(predicate, ' ', '_'), '-', '_'))[1:50] AS predicate FROM parsed",
)
def e4(spark, d):
    rows = G.parse_triplets(replies(spark, d))
    return rows.select("doc_id", "pos", G.normalize_predicate(F.col("predicate")).alias("predicate"))


@query(
    "e5_merge_graph",
    """
    SELECT c_name AS name, 'Customer' AS label, concat('segment=', CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END,
        CASE WHEN c_custkey % 2 = 0 THEN ';vip=yes' ELSE '' END) AS props FROM customer
    UNION ALL SELECT concat('New', c_name), 'Customer', 'segment=new;vip=yes' FROM customer WHERE c_custkey % 2 = 0
    """,
)
def e5(spark, d):
    customer = table(spark, d, "customer")
    old = customer.select(F.col("c_name").alias("name"), F.lit("Customer").alias("label"), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"))
    added = F.create_map(F.lit("segment"), F.lit("new"), F.lit("vip"), F.lit("yes"))
    even = customer.where("c_custkey % 2 = 0")
    new = even.select(F.col("c_name").alias("name"), F.lit("Customer").alias("label"), added.alias("props"))
    fresh = new.unionByName(new.withColumn("name", F.concat(F.lit("New"), "name")))
    none = table(spark, d, "region").select(*[F.col("r_name").alias(c) for c in ("src", "predicate", "dst")], F.create_map(F.lit("a"), F.lit("b")).alias("props"))
    merged, _ = G.merge_graph(old, fresh, none, none)
    text = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return merged.select("name", "label", text.alias("props"))


@query(
    "e6_related_entities",
    f"WITH {RELATED_SQL} SELECT seed, entity, relation, label FROM related QUALIFY row_number() OVER (PARTITION BY seed ORDER BY entity, relation, label) <= 10",
)
def e6(spark, d):
    return G.related_entities(seeds(spark, d), written(edges(spark, d), "edges"), nodes(spark, d))


_PAIRS_SQL = "pairs AS (SELECT c_name AS src, n_name AS dst FROM customer JOIN nation ON n_nationkey = c_custkey % 25 WHERE c_custkey % 50 < 2)"
_PATHS_SQL = """
    l1 AS (SELECT src, dst, b AS node, [src, b] AS nodes, [rel] AS rels FROM pairs JOIN ways ON a = src),
    l2 AS (SELECT src, dst, b AS node, list_append(nodes, b) AS nodes, list_append(rels, rel) AS rels FROM l1 JOIN ways ON a = node WHERE node <> dst),
    l3 AS (SELECT src, dst, b AS node, list_append(nodes, b) AS nodes, list_append(rels, rel) AS rels FROM l2 JOIN ways ON a = node AND b = dst WHERE node <> dst),
    found AS (SELECT * FROM l1 WHERE node = dst UNION ALL SELECT * FROM l2 WHERE node = dst UNION ALL SELECT * FROM l3 WHERE node = dst),
    paths AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY len(nodes), nodes, rels) = 1)
"""


@query(
    "e7_shortest_path",
    f"WITH {GRAPH_SQL}, {_PAIRS_SQL}, {_PATHS_SQL} SELECT src, dst, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM paths",
)
def e7(spark, d):
    nation = table(spark, d, "nation")
    pairs = table(spark, d, "customer").where("c_custkey % 50 < 2").join(nation, F.col("n_nationkey") == F.col("c_custkey") % 25)
    pairs = pairs.select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    found = G.shortest_path(pairs, written(edges(spark, d), "edges"))
    return found.select("src", "dst", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"))


@query("e8_triplets_by_relation", f"WITH {EDGES_SQL} SELECT src, predicate, dst FROM edges WHERE predicate = 'SUPPLIES' ORDER BY src, dst LIMIT 50")
def e8(spark, d):
    return G.triplets_by_relation(edges(spark, d), "SUPPLIES", 50)


@query(
    "e9_entity_profile",
    f"""
    WITH {NODES_SQL}, {EDGES_SQL}, {SEEDS_SQL}, names AS (SELECT seed AS name FROM seeds UNION ALL SELECT 'Nobody'),
    o AS (SELECT src AS name, string_agg(concat(predicate, ' ', dst), '; ' ORDER BY predicate, dst) AS t FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY predicate, dst) <= 10) GROUP BY 1),
    i AS (SELECT dst AS name, string_agg(concat(predicate, ' ', src), '; ' ORDER BY predicate, src) AS t FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY predicate, src) <= 10) GROUP BY 1),
    props AS (SELECT c_name AS name, concat('balance=', round(c_acctbal)::BIGINT, '; segment=', c_mktsegment) AS p FROM customer UNION ALL SELECT s_name, concat('balance=', round(s_acctbal)::BIGINT) FROM supplier)
    SELECT n.name, label, CASE WHEN label IS NOT NULL THEN coalesce(p, '') END AS properties, coalesce(o.t, '') AS outgoing, coalesce(i.t, '') AS incoming
    FROM names n LEFT JOIN nodes USING (name) LEFT JOIN props ON props.name = n.name LEFT JOIN o ON o.name = n.name LEFT JOIN i ON i.name = n.name
    """,
)
def e9(spark, d):
    names = seeds(spark, d).withColumnRenamed("seed", "name").unionByName(spark.range(1).select(F.lit("Nobody").alias("name")))
    def known(name, prefix, **more):
        pairs = {"balance": F.round(F.col(f"{prefix}_acctbal")).cast("long").cast("string"), **more}
        return table(spark, d, name).select(F.col(f"{prefix}_name").alias("name"), F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("props"))

    props = known("customer", "c", segment=F.col("c_mktsegment")).unionByName(known("supplier", "s"))
    rows = nodes(spark, d).join(props, "name", "left")
    rows = rows.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    return G.entity_profile(names, rows, edges(spark, d))


@query(
    "e10_graph_statistics",
    f"""
    WITH {NODES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM nodes) AS labels,
        (SELECT count(*) FROM edges) AS n_relations, (SELECT string_agg(DISTINCT predicate, ',' ORDER BY predicate) FROM edges) AS relation_types
    """,
)
def e10(spark, d):
    return G.graph_statistics(nodes(spark, d), edges(spark, d))


@query("e11_all_triplets", f"WITH {EDGES_SQL} SELECT src, predicate, dst FROM edges")
def e11(spark, d):
    return edges(spark, d)


QUESTIONS_SQL = "asked AS (SELECT c_custkey AS query_id, concat('what of ', c_name, ' and ', n_name, ' ?') AS question, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_custkey % 25 WHERE c_custkey % 50 = 0)"
# Facts of the entities in ``ent(query_id, i, seed)``: neighbours up to two edges away, and paths between entities.
TRIPLETS_SQL = """
    one AS (SELECT DISTINCT ent.seed, b AS entity, rel AS relation, e FROM ent JOIN ways ON a = ent.seed),
    rel AS (SELECT seed, entity, relation FROM one UNION SELECT seed, w.b, relation FROM one JOIN ways w ON w.a = one.entity AND w.e <> one.e),
    related AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY seed ORDER BY entity, relation) <= 10),
    triplets AS (SELECT query_id, 1 AS kind, i, entity AS o, 'triplet' AS type, [seed, entity] AS nodes, [relation] AS rels FROM ent JOIN related USING (seed))
"""
ENTITY_FACTS_SQL = f"""
    {TRIPLETS_SQL}, facts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, i, o, rels) AS place, type, nodes, rels FROM triplets QUALIFY place <= 5)
"""
FACTS_SQL = f"""
    {GRAPH_SQL}, {QUESTIONS_SQL}, ent AS (SELECT query_id, 0 AS i, c_name AS seed FROM asked UNION ALL SELECT query_id, 1, n_name FROM asked WHERE NOT contains(n_name, ' ')
        UNION ALL SELECT query_id, 1, unnest(string_split(n_name, ' ')) FROM asked WHERE contains(n_name, ' ')),
    {TRIPLETS_SQL},
    pairs AS (SELECT DISTINCT x.seed AS src, y.seed AS dst FROM ent x JOIN ent y ON x.query_id = y.query_id AND x.seed <> y.seed), {_PATHS_SQL},
    p AS (SELECT x.query_id, 0 AS kind, x.i, lpad(y.i::VARCHAR, 6, '0') AS o, 'path' AS type, nodes, rels FROM ent x JOIN ent y ON x.query_id = y.query_id AND x.seed <> y.seed JOIN paths ON src = x.seed AND dst = y.seed),
    facts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, i, o, rels) AS place, type, nodes, rels FROM (SELECT * FROM p UNION ALL SELECT * FROM triplets) QUALIFY place <= 5)
"""


def facts(spark, d):
    nation = table(spark, d, "nation")
    asked = table(spark, d, "customer").where("c_custkey % 50 = 0").join(nation, F.col("n_nationkey") == F.col("c_custkey") % 25)
    question = F.concat(F.lit("what of "), "c_name", F.lit(" and "), "n_name", F.lit(" ?"))
    return G.graph_facts(asked.select(F.col("c_custkey").alias("query_id"), question.alias("question")), nodes(spark, d), written(edges(spark, d), "edges"))


@query("e12_graph_facts", f"WITH {FACTS_SQL} SELECT query_id, place, type, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM facts")
def e12(spark, d):
    return facts(spark, d).select("query_id", "place", "type", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"))


@query(
    "e13_query_entities",
    r"""
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 2 AND upper(w[1]) = w[1] AND lower(w[1]) <> w[1]), ' ') AS entities FROM documents
    """,
)
def e13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(G.query_entities(F.col("text")), " ").alias("entities"))


@query(
    "e14_flatten_fact",
    f"""
    WITH {FACTS_SQL} SELECT query_id, place, CASE len(rels) WHEN 1 THEN concat(nodes[1], ' → [', rels[1], '] → ', nodes[2])
        WHEN 2 THEN concat(nodes[1], ' → [', rels[1], '] → ', nodes[2], ' → [', rels[2], '] → ', nodes[3])
        ELSE concat(nodes[1], ' → [', rels[1], '] → ', nodes[2], ' → [', rels[2], '] → ', nodes[3], ' → [', rels[3], '] → ', nodes[4]) END AS chain FROM facts
    """,
)
def e14(spark, d):
    return facts(spark, d).select("query_id", "place", G.flatten_fact(F.col("nodes"), F.col("rels")).alias("chain"))


# Facts as JSON in each shape that callers have used, and one that is cut off.
@query(
    "e14_read_facts",
    """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 6 IN (2, 3) THEN 'path' ELSE 'triplet' END AS type, CASE c_custkey % 6
        WHEN 2 THEN concat(c_name, ' → [LIVES_IN] → ', n_name, ' → [PART_OF] → ?') WHEN 3 THEN concat(c_name, ' → ', n_name)
        ELSE concat(c_name, ' → [', CASE c_custkey % 6 WHEN 5 THEN '' ELSE 'LIVES_IN' END, '] → ', n_name) END AS chain
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 <> 4
    """,
)
def e14_shapes(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))

    def text(*parts):
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])

    raw = {
        0: text('{"type": "triplet", "source": "', "c_name", '", "rel": "LIVES_IN", "target": "', "n_name", '"}'),
        1: text('{"source_entity": "', "c_name", '", "relationship": "LIVES_IN", "target_entity": "', "n_name", '"}'),
        2: text('{"type": "path", "nodes": ["', "c_name", '", "', "n_name", '", null], "rels": ["LIVES_IN", "PART_OF"]}'),
        3: text('{"type": "path", "from": "', "c_name", '", "to": "', "n_name", '"}'),
        4: text('{"source_entity": "', "c_name", '", "target_'),
        5: text('{"type": "other", "source": "', "c_name", '", "target": "', "n_name", '"}'),
    }
    shape = F.lit(None).cast("string")
    for k, v in raw.items():
        shape = F.when(F.col("c_custkey") % 6 == k, v).otherwise(shape)
    facts = G.read_facts(rows.select(F.col("c_custkey").alias("id"), shape.alias("raw")))
    return facts.select("id", "type", G.flatten_fact(F.col("nodes"), F.col("rels")).alias("chain"))


@query(
    "d17_format_graph_context",
    f"""
    WITH {FACTS_SQL}, c AS (SELECT query_id, place, list_reduce(list_transform(range(1, len(nodes) + 1), lambda i: CASE WHEN i <= len(rels) THEN concat(nodes[i], ' → [', rels[i], ']') ELSE nodes[i] END), lambda a, b: concat(a, ' → ', b)) AS chain FROM facts)
    SELECT query_id, string_agg(concat('• ', chain), chr(10) ORDER BY place) AS graph_context FROM c GROUP BY 1
    """,
)
def d17b(spark, d):
    return G.format_graph_context(facts(spark, d))


@query(
    "e15_embedded_only",
    f"WITH {REPLIES_SQL} SELECT doc_id, pos, subject, predicate, object FROM parsed WHERE doc_id IN (SELECT vec_id FROM embeddings)",
)
def e15(spark, d):
    embedded = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return G.embedded_only(G.parse_triplets(replies(spark, d)), embedded)
