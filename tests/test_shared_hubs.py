"""Paths between many entities and a hub that all of them name, both ways."""

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.sources.scratch import written


def test_a_named_hub_is_left_once_for_all_pairs(spark, monkeypatch):
    ids = spark.range(3000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("src"), F.col("id"))
    edges = ids.select("src", F.lit("IN").alias("predicate"), F.concat(F.lit("hub"), (F.col("id") % 2).cast("string")).alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([("hub0", "OF", "top"), ("hub1", "OF", "top")], "src string, predicate string, dst string"))
    asked = ids.where("id % 10 = 0").select("src", F.lit("hub1").alias("dst"))  # all of them at hub0
    rows = {}

    def counted(df, name):
        out = written(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    pairs = asked.unionByName(asked.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = {(r.src, r.dst): (r.nodes, r.rels) for r in graph.shortest_path(pairs, edges, 3).collect()}
    assert len(found) == 600 and found["x0", "hub1"] == (["x0", "hub0", "top", "hub1"], ["IN", "OF", "OF"])
    assert found["hub1", "x10"][0] == ["hub1", "top", "hub0", "x10"]
    assert max(rows["front"]) < 10_000 and max(rows["met"]) <= 600
