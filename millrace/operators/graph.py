"""Knowledge graph: triplets, nodes and edges, neighbourhoods, shortest paths, profiles, facts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip_fence, words
from millrace.sources.scratch import written
from millrace.sources.tables import likely_in

TRIPLETS = "struct<triplets:array<struct<subject:string,predicate:string,object:string>>>"


def parse_triplets(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``(…, pos, subject, predicate, object)``: complete items of each JSON reply; malformed replies give none."""
    parsed = F.from_json(strip_fence(F.col(raw)), TRIPLETS)
    rows = replies.select(*[c for c in replies.columns if c != raw], F.posexplode(parsed["triplets"]).alias("pos", "t"))
    rows = rows.where("t.subject IS NOT NULL AND t.predicate IS NOT NULL AND t.object IS NOT NULL")
    return rows.select(*[c for c in rows.columns if c not in ("pos", "t")], F.col("pos").cast("long").alias("pos"), "t.*")


def dedupe_triplets(triplets: DataFrame, order: list[str]) -> DataFrame:
    """The first triplet in order of those equal but for case: a pre-aggregated minimum per key."""
    keys = [F.lower(c).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    columns = [c for c in triplets.columns if c not in order]
    first = triplets.groupBy(*keys).agg(F.min(F.struct(*order, *columns)).alias("row"))
    return first.select(*[F.col(f"row.{c}").alias(c) for c in triplets.columns])


def drop_short_entities(triplets: DataFrame, least: int = 3) -> DataFrame:
    return triplets.where((F.length("subject") >= least) & (F.length("object") >= least))


def normalize_predicate(predicate: Column) -> Column:
    return F.substring(F.upper(F.translate(predicate, " -", "__")), 1, 50)


def merge_graph(nodes: DataFrame, new_nodes: DataFrame, edges: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent union of nodes ``(name, label, props map)`` and edges ``(src, predicate, dst, props map)``.

    Properties of the new rows override those of the old ones, key by key.
    """

    def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
        once = both.groupBy(*keys).agg(F.max(F.when(F.col("_age") == 0, 0)).alias("_o"), F.min("_age").alias("_a"))
        values = both.select(*keys, "_age", F.explode("props").alias("_k", "_v"))
        latest = values.groupBy(*keys, "_k").agg(F.max_by("_v", "_age").alias("_v"))
        props = latest.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias("props"))
        out = once.select(*keys).join(props, keys, "left")
        return out.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))

    return merged(nodes, new_nodes, ["name", "label"]), merged(edges, new_edges, ["src", "predicate", "dst"])


def both_ways(edges: DataFrame) -> DataFrame:
    """``(edge, a, b, rel)``: every edge once in each direction, with an id."""
    rows = edges.select(F.xxhash64("src", "predicate", "dst").alias("edge"), "src", "predicate", "dst")
    forward = rows.select("edge", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("predicate").alias("rel"))
    return forward.unionByName(rows.where("src <> dst").select("edge", F.col("dst").alias("a"), F.col("src").alias("b"), F.col("predicate").alias("rel")))


def ways_from(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of :func:`both_ways` that begin at one of ``nodes(node)``, and a few others: what a join by node must shuffle."""
    return likely_in(both_ways(edges), nodes.select(F.col("node").alias("a")), ["a"])


def related_entities(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, limit: int | None = 10) -> DataFrame:
    """``(seed, entity, relation, label)``: entities on undirected trails of up to ``depth`` edges from each seed.

    A trail uses no edge twice; ``relation`` is the trail's first edge. Distinct rows in order of entity and relation,
    ``limit`` for each seed (the report's size). Frontiers join the edge table by node, bounded by the seeds; ``edges`` is
    read once a step and should be a stored table, of which only the edges of a frontier's nodes are shuffled.

    With a limit the last step meets only the first neighbours of each node: an entity has a place among a seed's first
    ``limit`` rows only if fewer than that come before it by way of the same node, and a trail shuts out at most
    ``depth`` - 1 of them. So a hub in the middle of trails adds a few rows, not all its links. Only the edges of nodes that
    trails have reached are grouped, and trails that differ only in the order of their edges count once, as do repeated seeds
    and edges.
    """
    trail = seeds.select("seed").distinct().select(F.col("seed"), F.col("seed").alias("node"), F.lit(None).cast("string").alias("relation"), F.array().cast("array<bigint>").alias("used"))
    found = None
    for step in range(1, depth + 1):
        relation = F.coalesce("relation", "rel").alias("relation")
        if step == depth > 1 and limit is not None:
            trail = written(trail, "trails")
            reached = ways_from(trail, edges).join(trail.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
            pairs = reached.groupBy("a", "b").agg(F.slice(F.sort_array(F.collect_set("edge")), 1, depth).alias("edges"))
            place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
            first = pairs.withColumn("_p", place).where(F.col("_p") < limit + depth)
            ahead = trail.join(first, trail["node"] == first["a"]).where(F.size(F.array_except("edges", "used")) > 0)
            here = ahead.select("seed", F.col("b").alias("entity"), "relation").distinct()
        else:
            ways = ways_from(trail, edges)
            ahead = trail.join(ways, trail["node"] == ways["a"]).where(~F.array_contains("used", F.col("edge")))
            used = F.array_sort(F.array_append("used", F.col("edge"))).alias("used")
            trail = ahead.select("seed", F.col("b").alias("node"), relation, used).distinct()
            here = trail.select("seed", F.col("node").alias("entity"), "relation").distinct()
        found = here if found is None else found.unionByName(here)
    rows = found.distinct()
    if limit is not None:  # each row has a label at least, so later ones cannot come in
        place = F.row_number().over(Window.partitionBy("seed").orderBy("entity", "relation"))
        rows = rows.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")
    labels = nodes.select(F.col("name").alias("entity"), "label")
    out = rows.join(labels, "entity", "left").select("seed", "entity", "relation", "label")
    if limit is None:
        return out
    place = F.row_number().over(Window.partitionBy("seed").orderBy("entity", "relation", "label"))
    return out.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")


def shortest_path(pairs: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """``(src, dst, nodes, rels)``: a shortest undirected path of up to ``most`` edges for each pair that has one.

    Searched from both ends at once, all pairs together: frontiers belong to the distinct sources and the distinct targets,
    which pairs share. For each length each pair goes one step on at the end that costs it less: the links of that end's
    frontier, shared among the pairs that would take them. So a hub that many pairs name is left once for all of them, and a
    hub in the middle of paths is met and never left. Frontiers meet from the smaller one, by an equi-join on the other's
    root and node. A step keeps the smallest path for each root and node and drops nodes seen before; only ends of open
    pairs go further. Each step is a written table, and so are the links of the nodes that it reaches for the first time: no
    others are shuffled, and ``edges``, read once a step, should be a stored table. Among equal lengths the path of smallest nodes, then relations, wins.
    Pairs of equal ends have the path of that node.
    """
    wanted = written(pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "pairs")
    arrived = wanted.where("src = dst").select("src", "dst", F.array("src").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    wanted = wanted.where("src <> dst").select("src", "dst", F.lit(0).alias("src_step"), F.lit(0).alias("dst_step"))

    def start(end: str) -> DataFrame:
        root = wanted.select(F.col(end).alias("root")).distinct()
        none = F.array().cast("array<string>").alias("rels")
        return root.select(F.lit(end).alias("end"), "root", F.lit(0).alias("step"), F.col("root").alias("node"), F.array("root").alias("nodes"), none)

    reached, ways, counted = [], [], []  # of each step: nodes met first, their links, the numbers of these

    def sizes(rows: DataFrame) -> DataFrame:
        """Nodes and links of each frontier; those without links are left out, as nothing lies beyond them."""
        fresh = rows.select("node").distinct()
        fresh = written(fresh.join(reduce(DataFrame.unionByName, reached), "node", "left_anti") if reached else fresh, "nodes")
        links = ways_from(fresh, edges).select("a", "b", "rel").distinct()
        ways.append(written(links.join(fresh.withColumnRenamed("node", "a"), "a", "left_semi"), "ways"))
        reached.append(fresh)
        counted.append(written(ways[-1].groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links")), "degrees"))
        degrees = reduce(DataFrame.unionByName, counted)
        return written(rows.join(degrees, "node").groupBy("end", "root", "step").agg(F.count("*").alias("n"), F.sum("links").alias("links")), "sizes")

    def of(end: str, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.where(F.col("end") == end).select(F.col("root").alias(end), F.col("step").alias(f"{end}_step"), *columns)

    def with_sizes(rows: DataFrame) -> DataFrame:
        for end in ("src", "dst"):
            known = of(end, size, "n", "links").withColumnsRenamed({"n": f"{end}_n", "links": f"{end}_links"})
            rows = rows.join(known, [end, f"{end}_step"])
        return written(rows, "open")

    front = written(start("src").unionByName(start("dst")), "front")
    size = sizes(front)
    taken = None  # steps from which frontiers have been left
    live = with_sizes(wanted)
    for _ in range(most):
        costs = live
        for end in ("src", "dst"):
            sharing = live.groupBy(end, f"{end}_step").agg(F.count("*").alias("_sharing"))
            costs = costs.join(sharing, [end, f"{end}_step"]).withColumn(f"{end}_cost", F.col(f"{end}_links") / F.col("_sharing")).drop("_sharing")
        at_src = F.col("src_cost") <= F.col("dst_cost")
        costs = written(costs.select("src", "dst", "src_step", "dst_step", at_src.alias("at_src")), "costs")
        left = costs.where("at_src").select(F.lit("src").alias("end"), F.col("src").alias("root"), F.col("src_step").alias("step"))
        right = costs.where("NOT at_src").select(F.lit("dst").alias("end"), F.col("dst").alias("root"), F.col("dst_step").alias("step"))
        asked = left.unionByName(right).distinct()
        asked = written(asked if taken is None else asked.join(taken, ["end", "root", "step"], "left_anti"), "asked")
        taken = asked if taken is None else taken.unionByName(asked)
        if not asked.isEmpty():
            known = reduce(DataFrame.unionByName, ways)
            ahead = front.join(asked, ["end", "root", "step"]).join(known, F.col("node") == F.col("a"))
            first = F.col("end") == "src"
            nodes = F.when(first, F.array_append("nodes", F.col("b"))).otherwise(F.array_prepend("nodes", F.col("b")))
            rels = F.when(first, F.array_append("rels", F.col("rel"))).otherwise(F.array_prepend("rels", F.col("rel")))
            ahead = ahead.select("end", "root", (F.col("step") + 1).alias("step"), F.col("b").alias("node"), F.struct(nodes.alias("nodes"), rels.alias("rels")).alias("p"))
            ahead = ahead.join(front.select("end", "root", "node"), ["end", "root", "node"], "left_anti")
            ahead = written(ahead.groupBy("end", "root", "step", "node").agg(F.min("p").alias("p")).select("end", "root", "step", "node", "p.*"), "front")
            front, size = front.unionByName(ahead), size.unionByName(sizes(ahead))
        steps = [(F.col("src_step") + F.col("at_src").cast("int")).alias("src_step"), (F.col("dst_step") + (~F.col("at_src")).cast("int")).alias("dst_step")]
        live = with_sizes(costs.select("src", "dst", *steps))
        if live.isEmpty():  # no open pair, or none with an end to go on from
            break
        left, right = of("src", front, "node", "nodes", "rels"), of("dst", front, "node", F.col("nodes").alias("after"), F.col("rels").alias("on"))
        by_src = F.col("src_n") <= F.col("dst_n")
        keys = ["src", "dst", "src_step", "dst_step"]
        met = live.where(by_src).select(keys).join(left, keys[::2]).join(right, [*keys[1::2], "node"])
        met = met.unionByName(live.where(~by_src).select(keys).join(right, keys[1::2]).join(left, [*keys[::2], "node"]))
        nodes = F.concat("nodes", F.slice("after", 2, F.size("after")))
        met = met.groupBy("src", "dst").agg(F.min(F.struct(nodes.alias("nodes"), F.concat("rels", "on").alias("rels"))).alias("p"))
        met = written(met.select("src", "dst", "p.*"), "met")
        arrived, live = arrived.unionByName(met), written(live.join(met, ["src", "dst"], "left_anti"), "pairs")
    return arrived


def triplets_by_relation(edges: DataFrame, relation: str, limit: int) -> DataFrame:
    rows = edges.where(F.col("predicate") == relation).select("src", "predicate", "dst")
    return rows.orderBy("src", "dst").limit(limit)


def properties_text(props: Column) -> Column:
    """A property map as ``name=value`` in order of names, joined by ``; ``."""
    items = F.transform(F.array_sort(F.map_keys(props)), lambda k: F.concat(k, F.lit("="), F.coalesce(props[k], F.lit(""))))
    return F.array_join(items, "; ")


def entity_profile(names: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """``(name, label, properties, outgoing, incoming)`` as text; up to ``most`` relations each way.

    Properties come from ``nodes.props`` and behind each relation, in brackets, from ``edges.props`` where there are such
    maps (see :func:`merge_graph`); label and properties are null where the node is absent.
    """

    def side(end: str, other: str, alias: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(end).orderBy("predicate", other))
        rows = edges.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")
        kept = rows.withColumn("_p", place).where(F.col("_p") <= most)
        known = properties_text(F.col("props")) if "props" in edges.columns else F.lit("")
        shown = F.when(known != "", F.concat(F.lit("("), known, F.lit(")")))
        item = F.struct(F.col("_p"), F.concat_ws(" ", "predicate", other, shown).alias("t"))
        return kept.groupBy(F.col(end).alias("name")).agg(F.array_join(F.sort_array(F.collect_list(item))["t"], "; ").alias(alias))

    known = properties_text(F.col("props")) if "props" in nodes.columns else F.lit("")
    out = names.join(nodes.select("name", "label", known.alias("properties")), "name", "left")
    out = out.join(side("src", "dst", "outgoing"), "name", "left").join(side("dst", "src", "incoming"), "name", "left")
    return out.select("name", "label", "properties", *[F.coalesce(c, F.lit("")).alias(c) for c in ("outgoing", "incoming")])


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and relations, the labels and the relation types."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    e = edges.agg(F.count("*").alias("n_relations"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("relation_types"))
    return n.join(e, F.lit(True))  # one row each


def query_entities(question: Column) -> Column:
    """Capitalised words longer than two characters, in order."""

    def capital(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        return (F.length(w) > 2) & (F.upper(first) == first) & (F.lower(first) != first)

    return F.filter(words(question), capital)


def graph_facts(questions: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5, depth: int = 2, per_entity: int = 10) -> DataFrame:
    """``(query_id, place, type, nodes, rels)``: paths between a question's entities, then triplets, ``most`` in all.

    Paths are taken for ordered pairs of distinct entities, in order of mention; triplets are distinct by source,
    relation and target but for case.
    """
    asked = questions.select("query_id", F.posexplode(query_entities(F.col("question"))).alias("i", "seed"))
    seeds = asked.select("seed").distinct()
    related = related_entities(seeds, edges, nodes, depth, per_entity)
    triplets = asked.join(related, "seed").groupBy("query_id", F.lower("seed"), "relation", F.lower("entity")).agg(
        F.min(F.struct("i", "entity", "relation", "seed")).alias("t")
    )
    triplets = triplets.select(
        "query_id",
        F.lit(1).alias("kind"),
        F.col("t.i").alias("i"),
        F.col("t.entity").alias("o"),
        F.lit("triplet").alias("type"),
        F.array("t.seed", "t.entity").alias("nodes"),
        F.array("t.relation").alias("rels"),
    )
    other = asked.select("query_id", F.col("i").alias("j"), F.col("seed").alias("dst"))
    pairs = asked.join(other, "query_id").where("seed <> dst").select("query_id", "i", "j", F.col("seed").alias("src"), "dst")
    found = pairs.join(shortest_path(pairs, edges, 3), ["src", "dst"])
    paths = found.select("query_id", F.lit(0).alias("kind"), "i", F.lpad(F.col("j").cast("string"), 6, "0").alias("o"), F.lit("path").alias("type"), "nodes", "rels")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "i", "o", "rels"))
    rows = paths.unionByName(triplets).withColumn("place", place.cast("long")).where(F.col("place") <= most)
    return rows.select("query_id", "place", "type", "nodes", "rels")


def flatten_fact(nodes: Column, rels: Column) -> Column:
    """A fact as a chain of nodes and relations; missing nodes show as a question mark."""
    named = F.transform(nodes, lambda n: F.coalesce(n, F.lit("?")))
    steps = F.transform(named, lambda n, i: F.concat_ws(" → ", n, F.when(i < F.size(rels), F.concat(F.lit("["), F.get(rels, i), F.lit("]")))))
    return F.array_join(steps, " → ")


FACT = "type string, nodes array<string>, rels array<string>, source string, target string, rel string, source_entity string, target_entity string, relationship string, from string, to string"


def read_facts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``type``, ``nodes`` and ``rels`` of JSON facts in any of their shapes; rows without a readable fact fall away.

    A path has ``nodes`` and ``rels``, or in its older shape only ``from`` and ``to``; a triplet has ``source``, ``rel`` and
    ``target``, in its older shape ``source_entity``, ``relationship`` and ``target_entity``, and needs both ends.
    """
    fact = F.from_json(raw, FACT)
    path = F.col("_f.type") == "path"
    source, target, rel = (F.coalesce(F.nullif(f"_f.{old}", F.lit("")), f"_f.{new}") for old, new in (("source_entity", "source"), ("target_entity", "target"), ("relationship", "rel")))
    nodes = F.when(path, F.coalesce("_f.nodes", F.array("_f.from", "_f.to"))).otherwise(F.array(source, target))
    rels = F.when(path, F.coalesce("_f.rels", F.array().cast("array<string>"))).otherwise(F.array(F.coalesce(rel, F.lit(""))))
    whole = F.when(path, F.exists(nodes, lambda n: n.isNotNull())).otherwise((F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != ""))
    out = rows.withColumn("_f", fact).where(whole)
    return out.withColumns({"type": F.when(path, "path").otherwise("triplet"), "nodes": nodes, "rels": rels}).drop("_f", raw)


def embedded_only(triplets: DataFrame, embedded: DataFrame) -> DataFrame:
    """Triplets of documents that have been embedded already."""
    return triplets.join(embedded.select("doc_id").distinct(), "doc_id", "left_semi")


def format_graph_context(facts: DataFrame, most: int = 10) -> DataFrame:
    """``(query_id, graph_context)``: a question's facts as one line each, in order."""
    line = F.concat(F.lit("• "), flatten_fact(F.col("nodes"), F.col("rels")))
    kept = facts.where(F.col("place") <= most).select("query_id", F.struct(F.col("place").alias("o"), line.alias("l")).alias("x"))
    grouped = kept.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("query_id", F.array_join("xs.l", "\n").alias("graph_context"))


def clear_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty tables of the same schema, to overwrite the stored ones with."""
    return nodes.limit(0), edges.limit(0)
