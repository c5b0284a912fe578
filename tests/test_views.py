import pytest

from quarry.operators import graph as G

NODES = [("a", "/x/a.md", "/x/"), ("b", "/x/b.md", "/x/"), ("c", "/y/c.md", "/y/"), ("d", "/y/d.md", "/y/"), ("e", "/y/e.md", "/y/")]
LINKS = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("e", None), ("zz", "a")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, path string, namespace string")
    return nodes, spark.createDataFrame([(s, f"/{t}", t) for s, t in LINKS], "source_id string, target_path string, target_id string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_selection(spark, graph):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("none",), (None,)], "id string")
    nodes, links = G.selection(*graph, ids)
    assert rows(links, "source_id", "target_id") == [("a", "b"), ("a", "b"), ("b", "a"), ("d", "d")]
    assert rows(nodes, "id", "inbound", "outbound", "broken") == [("a", 1, 2, 0), ("b", 2, 1, 0), ("d", 1, 1, 0)]
    assert G.selection(*graph, ids.limit(0))[0].count() == 0


@pytest.mark.parametrize("size", [1, 2, 10])
def test_pages(spark, graph, size):
    nodes, links = graph
    members = nodes.selectExpr("id", "nullif(namespace, '/y/') as cluster", "1 as page").union(spark.createDataFrame([(None, "/x/", 1)], "id string, cluster string, page int"))
    page, expected = {}, {}
    for cluster in ("/x/", None):
        ids = sorted(i for i, _, n in NODES if (n if n != "/y/" else None) == cluster)
        for at in range(0, len(ids), size):
            part = ids[at : at + size]
            page |= {i: (cluster, at // size) for i in part}
            expected[cluster, at // size] = [len(part), part[0], part[-1], 0]
    for s, t in LINKS:
        if s in page and page.get(t) == page[s]:
            expected[page[s]][3] += 1
    assert rows(G.pages(members, links, size), "cluster", "page", "nodes", "first", "last", "links") == sorted([(*k, *v) for k, v in expected.items()], key=repr)


def test_paths_in_order(spark, graph):
    asked = [(1, ["d", "zz", "a", None, "d"]), (2, []), (3, None), (4, ["zz"]), (5, ["b"])]
    found = G.paths_in_order(spark.createDataFrame(asked, "request int, ids array<string>").selectExpr("*", "'x' as path"), graph[0])
    assert rows(found, "request", "paths") == [(1, ["/y/d.md", "/x/a.md", "/y/d.md"]), (2, []), (3, []), (4, []), (5, ["/x/b.md"])]
