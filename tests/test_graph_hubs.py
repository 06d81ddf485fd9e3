"""Related entities around hubs, parallel edges and deeper trails, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators.graph import related_entities, shortest_path
from millrace.sources.scratch import written


@pytest.mark.parametrize("depth,limit", [(1, 3), (2, 3), (2, 10), (3, 4), (2, None)])
def test_first_entities_of_hubs(spark, depth, limit):
    links = [(f"c{i:03d}", "IN", "hub") for i in range(60)] + [("hub", "OF", "top"), ("c001", "KNOWS", "hub"), ("c001", "KNOWS", "c002"), ("top", "IS", "top")]
    names = sorted({x for a, _, b in links for x in (a, b)})
    edges = spark.createDataFrame(links, "src string, predicate string, dst string")
    nodes = spark.createDataFrame([(n, n[0]) for n in names], "name string, label string")
    seeds = ["c001", "c002", "hub", "top", "nowhere"]
    ways = [(i, a, b, p) for i, (a, p, b) in enumerate(links)] + [(i, b, a, p) for i, (a, p, b) in enumerate(links) if a != b]
    want = set()
    for seed in seeds:
        rows, front = set(), [(seed, None, ())]
        for _ in range(depth):
            front = [(b, r or p, (*used, e)) for node, r, used in front for e, a, b, p in ways if a == node and e not in used]
            rows |= {(node, r) for node, r, _ in front}
        want |= {(seed, n, r, n[0]) for n, r in sorted(rows)[:limit]}
    got = related_entities(spark.createDataFrame([(s,) for s in seeds], "seed string"), edges, nodes, depth, limit)
    assert {tuple(r) for r in got.collect()} == want


def plain_path(links, src, dst, most):
    """The shortest path, of equal ones that of smallest nodes and then relations."""
    ways = {}
    for a, p, b in links:
        ways.setdefault(a, set()).add((b, p))
        ways.setdefault(b, set()).add((a, p))
    front = [((src,), ())]
    for _ in range(most + 1):
        found = [(n, r) for n, r in front if n[-1] == dst]
        if found:
            return tuple(map(list, min(found)))
        front = [((*n, b), (*r, p)) for n, r in front for b, p in ways.get(n[-1], ()) if b not in n]
    return None


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5])
def test_paths_from_both_ends_equal_plain_search(spark, most):
    rng = random.Random(most)
    names = [f"n{i:02d}" for i in range(26)]
    links = sorted({(rng.choice(names), rng.choice("pqr"), rng.choice(names)) for _ in range(34)})
    links += [("n00", "p", "hub"), *((f"x{i}", "q", "hub") for i in range(30)), ("hub", "r", "n25"), ("alone", "p", "other")]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("n00", "n25"), ("x1", "x2"), ("alone", "n00"), ("n03", "n03"), ("nobody", "n01"), (None, "n01")]
    got = shortest_path(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(links, "src string, predicate string, dst string"), most)
    want = {(a, b): plain_path(links, a, b, most) for a, b in pairs if a}
    assert {(r.src, r.dst): (r.nodes, r.rels) for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_a_hub_between_two_entities_is_not_expanded(spark, monkeypatch):
    edges = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("src"), F.lit("IN").alias("predicate"), F.lit("hub").alias("dst"))
    more = spark.createDataFrame([("a", "P", "hub"), ("b", "Q", "hub"), ("c", "Q", "d"), ("d", "P", "hub")], "src string, predicate string, dst string")
    rows = {}

    def counted(df, name):
        out = written(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    found = {r.dst: r.nodes for r in shortest_path(pairs, edges.unionByName(more), 3).collect()}
    assert found == {"b": ["a", "hub", "b"], "c": ["a", "hub", "d", "c"]}
    assert max(rows["front"]) < 10
