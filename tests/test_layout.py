"""Clusters by namespace, their ids and places, and edges under caps."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.catalog import QUERIES
from quarry.operators import graph as G

NODES = "id string, namespace string"
LINKS = "source_id string, target_id string"


def laid(spark, nodes, links, limit=500, parts=3):
    n = spark.createDataFrame(nodes, NODES).selectExpr("*", "1 as root", "2 as number", "3 as size", "4 as cluster").repartition(parts)
    return {r.id: r.cluster for r in G.layout(n, spark.createDataFrame(links, LINKS).repartition(parts), limit).collect()}


def test_order_does_not_matter(spark):
    nodes = [("a", "/x/"), ("b", "/x/"), ("c", "/y/"), ("d", "/y/")]
    links = [("a", "b"), ("c", "d"), ("b", "c"), ("a", None), ("a", "gone")]
    one = laid(spark, nodes, links)
    assert one == laid(spark, nodes[::-1], links[::-1], parts=1)
    assert one["a"] == one["b"] != one["c"] == one["d"]
    members = spark.createDataFrame(list(one.items()), "id string, cluster string")
    assert [(r.source, r.target, r.links) for r in G.between(spark.createDataFrame(links, LINKS), members).collect()] == [(one["a"], one["c"], 1)]
    # other members, another id; of another namespace too
    assert laid(spark, [*nodes, ("e", "/x/")], [*links, ("e", "b")])["a"] != one["a"]
    assert one["a"].startswith("cluster:x:0:") and len(one["a"].split(":")[-1]) == 12
    assert laid(spark, [("a", "/")], [])["a"].startswith("cluster:root:0:")


def test_sparse_namespace(spark):
    one = laid(spark, [(f"n{i}", "/skills/") for i in range(10)], [])
    assert len(set(one.values())) == 1
    # two groups of two and one alone: not sparse
    some = laid(spark, [(x, "/s/") for x in "abcde"], [("a", "b"), ("d", "c")])
    assert some["a"] == some["b"] and some["c"] == some["d"] and len(set(some.values())) == 3
    assert [some[x].split(":")[2] for x in "ace"] == ["0", "1", "2"]
    # half of the groups are single: sparse
    assert len(set(laid(spark, [(x, "/s/") for x in "abc"], [("a", "b")]).values())) == 1


def test_cluster_bound(spark):
    nodes = [(f"n{i:02}", f"/s{i:02}/") for i in range(20)]
    got = laid(spark, nodes, [], limit=5)
    assert len(set(got.values())) == 5 and "cluster:overflow" in got.values() and len(got) == 20
    assert sorted(set(laid(spark, nodes, [], limit=20).values())) == sorted(set(laid(spark, nodes, []).values()))


def test_long_chain(spark):
    got = laid(spark, [(f"n{i:05}", "/c/") for i in range(2000)], [(f"n{i:05}", f"n{i + 1:05}") for i in range(1999)])
    assert len(got) == 2000 and len(set(got.values())) == 1


def test_places(spark):
    rows = spark.createDataFrame([(f"c{i}",) for i in range(7)], "cluster string")
    got = G.placed(rows, "r1").orderBy("cluster").collect()
    assert [r.ordinal for r in got] == list(range(7)) and {r.total for r in got} == {7}
    assert all(abs(r.x**2 + r.y**2 - (3 + 7**0.5 * 0.6) ** 2) < 1e-9 and -1 <= r.z <= 1 for r in got)
    assert [(r.x, r.y, r.z) for r in got] == [(r.x, r.y, r.z) for r in G.placed(rows, "r1").orderBy("cluster").collect()] != [(r.x, r.y, r.z) for r in G.placed(rows, "r2").orderBy("cluster").collect()]
    assert G.placed(rows.limit(0), "r1").collect() == [] and laid(spark, [], []) == {}


def walk(edges, most):
    used, taken = {}, []
    for i, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[0])):
        if a == b and used.get(a, 0) + 2 <= most or a != b and used.get(a, 0) < most and used.get(b, 0) < most:
            taken.append(i)
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
    return sorted(taken)


@pytest.mark.parametrize("most", [1, 3])
def test_greedy_edges(spark, most):
    r = random.Random(most)
    for n, m in ((6, 30), (40, 300)):
        edges = {f"e{i:03}": (f"v{min(r.randrange(n), r.randrange(n))}", f"v{r.randrange(n)}", r.choice([0.5, 0.7, r.random()])) for i in range(m)}
        rows = [(i, *e) for i, e in edges.items() if e[0] != e[1]]
        df = spark.createDataFrame(rows, "id string, a string, b string, similarity double").selectExpr("*", "1 as node", "2 as used", "3 as r", "4 as k")
        assert sorted(x.id for x in G.greedy_edges(df, most).collect()) == walk(rows, most)
    assert G.greedy_edges(df.limit(0), most).collect() == [] == G.greedy_edges(df, 0).collect()


def test_greedy_hub(spark):
    """All edges at one node, and a chain in which each waits for the one before."""
    rows = [(f"h{i:03}", "hub", f"x{i}", i / 1000) for i in range(200)] + [(f"c{i:03}", f"p{i}", f"p{i + 1}", 1 - i / 1000) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, a string, b string, similarity double")
    assert sorted(x.id for x in G.greedy_edges(df, 1).collect()) == walk(rows, 1)


def counts(df):
    return sorted((r.source, r.target, r.links) for r in df.collect())


def test_spaced_links(spark):
    """Ends' namespaces, and counts by namespaces, are those of joins by id: namespaces of one cluster and of several, ids in two, none, unknown and broken links."""
    r = random.Random(3)
    rows = [(f"n{i:02}", f"/{i}", f"/s{i % 5}/" if i % 9 else None) for i in range(40)] + [("n03", "/again", "/s4/")]
    nodes = spark.createDataFrame(rows, "id string, path string, namespace string").repartition(3)
    raw = [(f"n{r.randrange(42):02}", f"/{r.randrange(44)}") for _ in range(400)] + [("n05", "/again"), (None, "/1"), ("n01", None)]
    raw = spark.createDataFrame(raw, "source_id string, target_path string").repartition(3)
    links, plain = G.spaced(raw, nodes), G.resolve(raw, nodes)
    space = {}
    for i, _, s in rows:
        space.setdefault(i, []).append(s)
    none = [None]
    want = [(x.source_id, x.target_id, s, t) for x in plain.collect() for s in space.get(x.source_id, none) for t in space.get(x.target_id, none)]
    assert sorted(map(str, want)) == sorted(str((x.source_id, x.target_id, x.source_namespace, x.target_namespace)) for x in links.collect())
    laid = spark.createDataFrame(G.layout(nodes, plain).collect(), "id string, namespace string, cluster string")
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, G.layout(nodes, links).collect()))
    # /s0/ and /s1/ lie in several clusters, /s2/ and /s3/ in one
    split = laid.withColumn("cluster", F.when(F.col("namespace").isin("/s0/", "/s1/"), F.concat(F.lit("c"), F.substring("id", 3, 1))).when(F.col("namespace") == "/s4/", "own").otherwise("both"))
    for members in (laid, split):
        want = counts(G.between(plain, members))
        assert want and all(counts(G.between(links, members, most)) == want for most in (0, 2, 100))
    assert counts(G.between(links.limit(0), laid)) == [] == counts(G.between(links, laid.limit(0)))


def test_edges_of_links_found_once(spark, sf):
    """The links are written once: counting them reads none of the tables that they are made of."""
    df = QUERIES["layout_edges"](spark, sf)
    assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())
