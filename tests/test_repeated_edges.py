"""Repeated seeds and edges give one trail, not one for each pair of their copies."""

from millrace.operators import graph


def test_trails_of_repeated_seeds_and_edges(spark, monkeypatch):
    sizes = {}
    plain = graph.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(graph, "written", counted)
    copies = 20
    seeds = spark.createDataFrame([("a",), ("b",)] * copies, "seed string")
    edges = spark.createDataFrame([("a", "to", "n"), ("b", "to", "n"), ("n", "in", "r")] * copies, "src string, predicate string, dst string")
    nodes = spark.createDataFrame([(x, "Node") for x in "abnr"], "name string, label string")
    got = sorted(tuple(r) for r in graph.related_entities(seeds, edges, nodes).collect())
    assert got == sorted([("a", "n", "to", "Node"), ("a", "b", "to", "Node"), ("a", "r", "to", "Node"), ("b", "n", "to", "Node"), ("b", "a", "to", "Node"), ("b", "r", "to", "Node")])
    assert sizes["trails"] == 2
