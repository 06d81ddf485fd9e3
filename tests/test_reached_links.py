"""Graph searches keep the links of the nodes they reach, not those of the whole graph."""

from millrace.operators import graph
from millrace.sources.scratch import written


def test_links_of_unreached_nodes_are_not_stored(spark, monkeypatch):
    links = [(f"a{i}", "to", f"a{i + 1}") for i in range(6)] + [(f"b{i}", "to", f"b{i % 40}") for i in range(3000)]
    edges = spark.createDataFrame(links, "src string, predicate string, dst string")
    pairs = spark.createDataFrame([("a0", "a3"), ("a5", "a5"), ("a1", "a6"), ("a1", "nowhere")], "src string, dst string")
    rows = {}

    def counted(df, name):
        out = written(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    found = {(r.src, r.dst): len(r.rels) for r in graph.shortest_path(pairs, edges, 3).collect()}
    assert found == {("a0", "a3"): 3, ("a5", "a5"): 0}
    assert sum(rows["ways"]) <= 12  # each of the links of the seven nodes once in each direction
    rows.clear()
    seeds = spark.createDataFrame([("a2",)], "seed string")
    nodes = spark.createDataFrame([(f"a{i}", "A") for i in range(7)], "name string, label string")
    got = {(r.entity, r.relation) for r in graph.related_entities(seeds, edges, nodes).collect()}
    assert got == {(f"a{i}", "to") for i in (0, 1, 3, 4)}
    assert "ways" not in rows
