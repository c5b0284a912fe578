"""Queries: links, degrees, neighbourhoods, clusters and one query for each diagnostic rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators.tables import components, cut
from quarry.plans.registry import CONCEPTS, GRAPH, PROPOSALS, VECTORS, registry
from quarry.sources.tables import concepts, graph_nodes, proposals, raw_links, table, vectors

QUERIES, ORACLES, query = registry()


def linked(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return nodes, G.resolve(raw_links(spark, sf_dir), nodes)


@query(GRAPH, "SELECT source_id, target_path, target_id FROM links")
def link_resolution(spark, sf_dir):
    return linked(spark, sf_dir)[1].select("source_id", "target_path", "target_id")


@query(GRAPH, "SELECT DISTINCT source_id, target_path FROM links WHERE target_id IS NULL")
def broken_targets(spark, sf_dir):
    return linked(spark, sf_dir)[1].where("target_id is null").select("source_id", "target_path").distinct()


@query("""SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) WHERE target NOT IN (SELECT url FROM pages) GROUP BY page_id, target""")
def page_broken_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return out.join(pages.select(F.col("url").alias("target")), "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(GRAPH, "SELECT target_id AS id, count(*) AS n, min(source_id) AS first FROM links WHERE target_id IS NOT NULL GROUP BY target_id")
def backlinks(spark, sf_dir):
    return linked(spark, sf_dir)[1].where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"), F.min("source_id").alias("first"))


METRICS = """metrics AS (SELECT n.id, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, coalesce(o.b, 0) AS broken FROM nodes n
  LEFT JOIN (SELECT target_id, count(*) AS n FROM links GROUP BY target_id) i ON n.id = i.target_id
  LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (target_id IS NULL) AS b FROM links GROUP BY source_id) o ON n.id = o.source_id)"""


@query(GRAPH, METRICS, "SELECT id, inbound, outbound, broken, inbound = 0 AND outbound = 0 AS orphan FROM metrics")
def graph_metrics(spark, sf_dir):
    return G.degrees(*linked(spark, sf_dir))


SCOPED = "nodes AS (SELECT * FROM nodes0 WHERE id NOT LIKE '%7'), links AS (SELECT l.* FROM links0 l WHERE source_id IN (SELECT id FROM nodes) AND (target_id IS NULL OR target_id IN (SELECT id FROM nodes)))"


@query(GRAPH.replace("nodes AS", "nodes0 AS").replace("links AS", "links0 AS").replace("JOIN nodes ON", "JOIN nodes0 ON"), SCOPED, METRICS.replace("count(*) AS n, count(*) FILTER (target_id IS NULL) AS b", "count(*) FILTER (target_id IS NOT NULL) AS n, count(*) FILTER (target_id IS NULL) AS b"), "SELECT id, inbound, outbound, broken FROM metrics")
def scoped_degrees(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    nodes = nodes.where("id not like '%7'")
    found = G.degrees(nodes, G.scoped(nodes, links))
    return found.select("id", "inbound", (F.col("outbound") - F.col("broken")).alias("outbound"), "broken")


def reach_sql(a: str, b: str) -> tuple[str, ...]:
    return (
        GRAPH,
        f"walk AS (SELECT id AS start, id, 0 AS depth FROM nodes WHERE id LIKE 's%5' UNION SELECT w.start, l.{b}, w.depth + 1 FROM walk w JOIN links l ON l.{a} = w.id WHERE w.depth < 2 AND l.{a} IS NOT NULL AND l.{b} IS NOT NULL)",
        "SELECT start, id, min(depth)::INT AS depth FROM walk WHERE id <> start GROUP BY start, id",
    )


@query(*reach_sql("source_id", "target_id"))
def bfs_outbound_2(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    return G.reach(links, nodes.where("id like 's%5'"), 2)


@query(*reach_sql("target_id", "source_id"))
def bfs_inbound_2(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    return G.reach(links, nodes.where("id like 's%5'"), 2, "in")


@query(GRAPH, "SELECT DISTINCT s AS start, id FROM (SELECT source_id AS s, target_id AS id FROM links UNION ALL SELECT target_id, source_id FROM links) WHERE s IS NOT NULL AND id IS NOT NULL AND s <> id AND s LIKE 's%3'")
def neighbourhood_1hop(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    some = nodes.where("id like 's%3'")
    return G.reach(links, some, 1).union(G.reach(links, some, 1, "in")).select("start", "id").distinct()


REACH = "step AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM links WHERE target_id IS NOT NULL UNION SELECT target_id, source_id FROM links WHERE target_id IS NOT NULL), near AS (SELECT id AS a, id AS b FROM nodes UNION SELECT n.a, l.b FROM near n JOIN step l ON n.b = l.a), named AS (SELECT a AS id, min(b) AS root FROM near GROUP BY a)"


def rooted(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    roots = components(links.where("target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    return nodes, links, roots


@query(GRAPH, REACH, "SELECT id, root FROM named")
def components_all(spark, sf_dir):
    nodes, _, roots = rooted(spark, sf_dir)
    return nodes.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


CLUSTERS = "top AS (SELECT root FROM named GROUP BY root ORDER BY count(*) DESC, root LIMIT 4), members AS (SELECT id, CASE WHEN root IN (SELECT root FROM top) THEN root ELSE 'overflow' END AS cluster FROM named)"


@query(GRAPH, REACH, CLUSTERS, METRICS, "SELECT cluster, count(*) AS members, sum(inbound)::BIGINT AS inbound, sum(outbound)::BIGINT AS outbound, sum(broken)::BIGINT AS broken FROM members JOIN metrics USING (id) GROUP BY cluster")
def cluster_aggregate(spark, sf_dir):
    nodes, links, roots = rooted(spark, sf_dir)
    rows = G.clusters(nodes, roots, 5).join(G.degrees(nodes, links), "id")
    return rows.groupBy("cluster").agg(F.count("*").alias("members"), *[F.sum(c).alias(c) for c in ("inbound", "outbound", "broken")])


@query(GRAPH, "SELECT s.namespace AS source, t.namespace AS target, count(*) AS links FROM links l JOIN nodes s ON s.id = l.source_id JOIN nodes t ON t.id = l.target_id WHERE s.namespace <> t.namespace GROUP BY 1, 2")
def intercluster_edges(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    return G.between(links, nodes.select("id", F.col("namespace").alias("cluster")))


@query(CONCEPTS, "SELECT * FROM (SELECT t AS tag, id AS a, lead(id) OVER (PARTITION BY t ORDER BY id) AS b FROM (SELECT id, unnest(tags) AS t FROM concepts)) WHERE b IS NOT NULL")
def shared_tag_chain(spark, sf_dir):
    return G.tag_chain(concepts(spark, sf_dir))


@query(GRAPH, METRICS, "SELECT count(*) AS nodes, sum(outbound)::BIGINT AS links, sum(broken)::BIGINT AS broken, count(*) FILTER (inbound = 0 AND outbound = 0) AS orphans, count(*) >= 12 AND sum(outbound) - sum(broken) < greatest(1, count(*) // 4) AND avg(CASE WHEN inbound = 0 AND outbound = 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS sparse FROM metrics")
def overview_metrics(spark, sf_dir):
    m = G.degrees(*linked(spark, sf_dir))
    sums = m.agg(F.count("*").alias("nodes"), F.sum("outbound").alias("links"), F.sum("broken").alias("broken"), F.count_if("orphan").alias("orphans"))
    few = F.col("links") - F.col("broken") < F.greatest(F.lit(1).cast("long"), F.floor(F.col("nodes") / 4))
    return sums.withColumn("sparse", (F.col("nodes") >= 12) & few & (F.col("orphans") / F.col("nodes") >= 0.5))


EDGES = "edges AS (SELECT 0 AS layer, source_id AS a, target_id AS b FROM links WHERE target_id IS NOT NULL UNION ALL SELECT 1, a.id, b.id FROM vectors a JOIN vectors b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95 AND a.status = 'ready' AND b.status = 'ready')"


@query(GRAPH, VECTORS, EDGES, "SELECT layer::INT AS layer, a, b FROM edges ORDER BY layer, a, b LIMIT 100000")
def edge_budget(spark, sf_dir):
    """Layers in turn: one is made only if those before it leave room, and of it no more than fits."""
    from quarry.operators.search import neighbours

    budget = 100_000
    out = linked(spark, sf_dir)[1].where("target_id is not null").select(F.lit(0).alias("layer"), F.col("source_id").alias("a"), F.col("target_id").alias("b")).orderBy("a", "b").limit(budget)
    left = budget - out.count()
    if left > 0:
        similar = neighbours(vectors(spark, sf_dir), 0.95, left).where("a < b").select(F.lit(1).alias("layer"), "a", "b")
        out = out.union(similar.orderBy("a", "b").limit(left))
    return out


def spaced(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return nodes, G.spaced(raw_links(spark, sf_dir), nodes)


LAYOUT = r"""inner_links AS (SELECT l.source_id AS a, l.target_id AS b FROM links l JOIN nodes s ON s.id = l.source_id JOIN nodes t ON t.id = l.target_id WHERE s.namespace = t.namespace),
step AS MATERIALIZED (SELECT a, b FROM inner_links UNION SELECT b, a FROM inner_links),
near AS (SELECT id AS a, id AS b FROM nodes UNION SELECT n.a, s.b FROM near n JOIN step s ON n.b = s.a),
named AS (SELECT n.id, n.namespace, min(near.b) AS root FROM nodes n JOIN near ON near.a = n.id GROUP BY n.id, n.namespace),
comp AS (SELECT namespace, root, count(*) AS size, row_number() OVER (PARTITION BY namespace ORDER BY root) - 1 AS number FROM named GROUP BY namespace, root),
space AS (SELECT namespace, min(root) AS least, count(*) > 1 AND avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END) >= 0.5 AS sparse FROM comp GROUP BY namespace),
grp AS (SELECT n.id, n.namespace, CASE WHEN sparse THEN least ELSE n.root END AS root, CASE WHEN sparse THEN 0 ELSE number END AS number FROM named n JOIN comp c ON c.namespace = n.namespace AND c.root = n.root JOIN space s ON s.namespace = n.namespace),
ids0 AS (SELECT namespace, root, count(*) AS size, 'cluster:' || coalesce(nullif(trim(namespace, '/'), ''), 'root') || ':' || any_value(number) || ':' || substr(sha256(namespace || chr(0) || count(*) || chr(0) || min(sha256(id)) || chr(0) || max(sha256(id))), 1, 12) AS own FROM grp GROUP BY namespace, root),
ids AS (SELECT *, CASE WHEN (SELECT count(*) FROM ids0) <= 5 OR row_number() OVER (ORDER BY size DESC, own) < 5 THEN own ELSE 'cluster:overflow' END AS cluster FROM ids0),
laid AS (SELECT g.id, g.namespace, cluster FROM grp g JOIN ids USING (namespace, root))"""


@query(GRAPH, LAYOUT, "SELECT id, namespace, cluster FROM laid")
def layout_members(spark, sf_dir):
    return G.layout(*spaced(spark, sf_dir), limit=5)


@query(GRAPH, LAYOUT, METRICS, "hexed AS (SELECT cluster, sha256('layout-1' || chr(0) || 'r1' || chr(0) || cluster) AS h, row_number() OVER (ORDER BY cluster) - 1 AS ordinal, count(*) OVER () AS total, n, inbound, outbound, broken FROM (SELECT cluster, count(*) AS n, sum(inbound)::BIGINT AS inbound, sum(outbound)::BIGINT AS outbound, sum(broken)::BIGINT AS broken FROM laid JOIN metrics USING (id) GROUP BY cluster))",
       "num AS (SELECT *, list_reduce(list_prepend(0, [strpos('0123456789abcdef', c) - 1 FOR c IN string_split(substr(h, 1, 8), '')]), lambda x, y: x * 16 + y) / 4294967296.0 - 0.5 AS jitter, list_reduce(list_prepend(0, [strpos('0123456789abcdef', c) - 1 FOR c IN string_split(substr(h, 9, 8), '')]), lambda x, y: x * 16 + y) / 4294967296.0 - 0.5 AS up FROM hexed)",
       "SELECT cluster, ordinal, total::INT AS total, n, inbound, outbound, broken, round(cos(2 * pi() * (ordinal + 0.5 + jitter * 0.2) / total) * (3 + sqrt(total) * 0.6), 6) AS x, round(sin(2 * pi() * (ordinal + 0.5 + jitter * 0.2) / total) * (3 + sqrt(total) * 0.6), 6) AS y, round(up * 2, 6) AS z FROM num")
def layout_clusters(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    rows = G.layout(*spaced(spark, sf_dir), limit=5).join(G.degrees(nodes, links), "id")
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("inbound", "outbound", "broken")])
    return G.placed(sums, "r1").select("cluster", "ordinal", "total", "n", "inbound", "outbound", "broken", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(GRAPH, LAYOUT, "SELECT s.cluster AS source, t.cluster AS target, count(*) AS links FROM links l JOIN laid s ON s.id = l.source_id JOIN laid t ON t.id = l.target_id WHERE s.cluster <> t.cluster GROUP BY 1, 2")
def layout_edges(spark, sf_dir):
    """Links are found once and written: clusters are made of them, and then they are counted."""
    nodes, links = spaced(spark, sf_dir)
    links = cut(links.where("source_namespace is not null and target_namespace is not null").drop("target_path"), "spaced")
    return G.between(links, G.layout(nodes, links, limit=5))


@query()
def display_edges(spark, sf_dir):
    """Edges between similar vectors, five at a node at most, the most similar first; rounds have no SQL, the tests walk one by one."""
    from quarry.operators.search import mutual, neighbours

    pairs = mutual(neighbours(vectors(spark, sf_dir), 0.2, 12))
    edges = pairs.select(F.concat_ws("|", "a", "b").alias("id"), "a", "b", F.round("cosine", 9).alias("similarity"))
    return G.greedy_edges(edges, 5)


CHOSEN = "chosen AS (SELECT id FROM nodes WHERE namespace = '/parts/' OR namespace = '/suppliers/'), inner_l AS (SELECT source_id, target_id FROM links WHERE source_id IN (SELECT id FROM chosen) AND target_id IN (SELECT id FROM chosen))"


@query(GRAPH, CHOSEN, "SELECT c.id, (SELECT count(*) FROM inner_l WHERE target_id = c.id) AS inbound, (SELECT count(*) FROM inner_l WHERE source_id = c.id) AS outbound FROM chosen c")
def selection_export(spark, sf_dir):
    """What lies in two namespaces, with degrees inside the selection."""
    nodes, links = linked(spark, sf_dir)
    return G.selection(nodes, links, nodes.where("namespace in ('/parts/', '/suppliers/')"))[0].select("id", "inbound", "outbound")


PAGED = """paged AS (SELECT id, namespace AS cluster, (row_number() OVER (PARTITION BY namespace ORDER BY id) - 1) // 40 AS page FROM nodes),
inner_p AS (SELECT s.cluster, s.page, count(*) AS links FROM links l JOIN paged s ON s.id = l.source_id JOIN paged t ON t.id = l.target_id AND t.cluster = s.cluster AND t.page = s.page GROUP BY s.cluster, s.page)"""


@query(GRAPH, PAGED, "SELECT p.cluster, p.page, count(*) AS nodes, min(id) AS first, max(id) AS last, coalesce(any_value(i.links), 0) AS links FROM paged p LEFT JOIN inner_p i ON i.cluster = p.cluster AND i.page = p.page GROUP BY p.cluster, p.page")
def cluster_pages(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    return G.pages(nodes.select("id", F.col("namespace").alias("cluster")), links, 40)


@query(GRAPH, "asked AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'gone' ELSE 'p' END || l_partkey AS id FROM lineitem)", "SELECT l_orderkey AS request, coalesce(string_agg(path, ' ' ORDER BY l_linenumber, id), '') AS paths FROM asked LEFT JOIN nodes USING (id) GROUP BY l_orderkey")
def paths_for_ids(spark, sf_dir):
    """The paths of each order's parts in its lines' order, equal line numbers by id; returned parts are asked for by an id that nothing has."""
    ident = F.concat(F.when(F.col("l_returnflag") == "R", "gone").otherwise("p"), "l_partkey")
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", ident.alias("id")))).alias("l"))
    found = G.paths_in_order(lists.select("request", F.col("l.id").alias("ids")), graph_nodes(spark, sf_dir))
    return found.select("request", F.array_join("paths", " ").alias("paths"))


RULE = "SELECT '{}' AS rule, '{}' AS severity, id FROM {}"


@query(GRAPH, METRICS, RULE.format("orphan", "warning", "metrics WHERE inbound + outbound = 0"))
def diag_orphan(spark, sf_dir):
    return G.diagnostic(G.degrees(*linked(spark, sf_dir)).where("orphan"), "orphan", "warning")


@query(GRAPH, METRICS, RULE.format("broken_links", "error", "metrics WHERE broken > 0"))
def diag_broken_links(spark, sf_dir):
    return G.diagnostic(G.degrees(*linked(spark, sf_dir)).where("broken > 0"), "broken_links", "error")


@query(GRAPH, METRICS, "degs AS (SELECT id, inbound + outbound AS d FROM metrics)", "cap AS (SELECT list_sort(list(d))[round_even((count(*) - 1) * 0.95, 0)::BIGINT + 1] AS p FROM degs)", RULE.format("high_degree", "info", "degs, cap WHERE d > greatest(20, p)"))
def diag_high_degree(spark, sf_dir):
    degs = G.degrees(*linked(spark, sf_dir)).select("id", (F.col("inbound") + F.col("outbound")).alias("d"))
    cap = G.nearest_rank(degs, "d", 0.95)  # one row
    return G.diagnostic(degs.crossJoin(F.broadcast(cap)).where(F.col("d") > F.greatest(F.lit(20).cast("long"), F.col("rank_value"))), "high_degree", "info")


@query(GRAPH, RULE.format("isolated_cluster", "info", "nodes WHERE namespace NOT IN (SELECT s.namespace FROM links l JOIN nodes s ON s.id = l.source_id JOIN nodes t ON t.id = l.target_id WHERE s.namespace <> t.namespace UNION SELECT t.namespace FROM links l JOIN nodes s ON s.id = l.source_id JOIN nodes t ON t.id = l.target_id WHERE s.namespace <> t.namespace)"))
def diag_isolated_cluster(spark, sf_dir):
    nodes, links = linked(spark, sf_dir)
    crossing = G.between(links, nodes.select("id", F.col("namespace").alias("cluster")))
    spaces = crossing.select(F.col("source").alias("namespace")).union(crossing.select("target"))
    return G.diagnostic(nodes.join(spaces, "namespace", "left_anti"), "isolated_cluster", "info")


def lifecycle(rule: str, severity: str, status: str):
    @query(VECTORS, RULE.format(rule, severity, f"vectors WHERE {status}"))
    def f(spark, sf_dir):
        return G.diagnostic(vectors(spark, sf_dir).where(status), rule, severity)

    QUERIES[f"diag_{rule}"], ORACLES[f"diag_{rule}"] = QUERIES.pop("f"), ORACLES.pop("f")


lifecycle("embedding_failed", "warning", "status = 'error'")
lifecycle("embedding_missing", "info", "status not in ('ready', 'error')")

# No table has revisions: an older one is derived from the concepts, some without their last edit and some not there yet.
OLDER = "older AS (SELECT id, sha256(CASE WHEN doc_id % 13 = 0 THEN body || 'old' ELSE body END) AS hash FROM concepts WHERE doc_id % 11 <> 0)"


def older(spark, sf_dir):
    c = concepts(spark, sf_dir).where("doc_id % 11 <> 0")
    return c.select("id", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("body", F.lit("old"))).otherwise(F.col("body")), 256).alias("hash"))


@query(CONCEPTS, OLDER, RULE.format("index_stale", "error", "(SELECT c.id FROM concepts c LEFT JOIN older o ON o.id = c.id WHERE o.hash IS DISTINCT FROM c.content_hash)"))
def diag_index_stale(spark, sf_dir):
    """Concepts that an index of the older revision lacks or has otherwise."""
    now = concepts(spark, sf_dir).select("id", F.col("content_hash").alias("hash"))
    return G.diagnostic(G.stale(now, older(spark, sf_dir)), "index_stale", "error")


@query(CONCEPTS, VECTORS, OLDER, RULE.format("embedding_stale", "warning", "(SELECT v.id FROM vectors v JOIN concepts c ON c.id = v.id LEFT JOIN older o ON o.id = c.id WHERE v.status = 'ready' AND o.hash IS DISTINCT FROM c.content_hash)"))
def diag_embedding_stale(spark, sf_dir):
    """Ready vectors of texts that have changed since."""
    ready = vectors(spark, sf_dir).where("status = 'ready'").select("id")
    now = concepts(spark, sf_dir).select("id", F.col("content_hash").alias("hash")).join(ready, "id", "left_semi")
    return G.diagnostic(G.stale(now, older(spark, sf_dir)), "embedding_stale", "warning")


@query(PROPOSALS, RULE.format("pending_proposals", "info", "(SELECT DISTINCT path AS id FROM proposals WHERE status IN ('draft', 'submitted', 'approved'))"))
def diag_pending_proposals(spark, sf_dir):
    from quarry.operators.state import proposal_counts

    return G.diagnostic(proposal_counts(proposals(spark, sf_dir)).where("pending > 0").withColumnRenamed("path", "id"), "pending_proposals", "info")


MAD = """sized AS (SELECT id, namespace, strlen(body)::DOUBLE AS size FROM concepts), mid AS (SELECT namespace, median(size) AS m FROM sized GROUP BY namespace HAVING count(size) >= 4),
off AS (SELECT s.*, m, abs(size - m) AS d FROM sized s JOIN mid USING (namespace)), mad AS (SELECT namespace, median(d) AS mad FROM off GROUP BY namespace)"""


@query(CONCEPTS, MAD, "SELECT id, namespace, size::BIGINT AS size FROM off JOIN mad USING (namespace) WHERE size > m + greatest(1024, 6 * mad)")
def diag_size_outlier(spark, sf_dir):
    return G.size_outliers(concepts(spark, sf_dir))


@query(CONCEPTS, "tg AS (SELECT DISTINCT id, namespace, unnest(tags) AS t FROM concepts), sz AS (SELECT namespace, count(*) AS n FROM concepts GROUP BY namespace HAVING count(*) >= 4), common AS (SELECT tg.namespace, t FROM tg JOIN sz USING (namespace) GROUP BY tg.namespace, t, n HAVING count(*) >= 0.2 * n)", "SELECT c.id, string_agg(t, ',' ORDER BY t) AS missing FROM concepts c JOIN common USING (namespace) WHERE NOT list_contains(tags, t) GROUP BY c.id")
def diag_tag_drift(spark, sf_dir):
    return G.tag_drift(concepts(spark, sf_dir), share=0.2)


@query(GRAPH, "ends AS (SELECT source_id AS id, target_id AS o FROM links WHERE target_id IS NOT NULL UNION ALL SELECT target_id, source_id FROM links WHERE target_id IS NOT NULL)", "SELECT e.id, count(*) AS linked, count(*) FILTER (a.namespace <> b.namespace) AS outside FROM ends e JOIN nodes a ON a.id = e.id JOIN nodes b ON b.id = e.o GROUP BY e.id HAVING count(*) >= 3 AND count(*) FILTER (a.namespace <> b.namespace) >= 0.8 * count(*)")
def diag_namespace_outlier(spark, sf_dir):
    return G.namespace_outliers(*linked(spark, sf_dir))


@query(CONCEPTS, "chain AS (SELECT DISTINCT a, b FROM (SELECT id AS a, lead(id) OVER (PARTITION BY t ORDER BY id) AS b FROM (SELECT id, unnest(tags) AS t FROM concepts)) WHERE b IS NOT NULL)",
       "SELECT a, b, round(len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))), 6) AS jaccard FROM chain JOIN concepts x ON x.id = a JOIN concepts y ON y.id = b")
def tag_jaccard(spark, sf_dir):
    c = concepts(spark, sf_dir)
    pairs = G.tag_chain(c).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(c.select(F.col("id").alias(x), F.col("tags").alias("t" + x)), x)
    return pairs.select("a", "b", F.round(G.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


RULES = ["orphan", "broken_links", "high_degree", "isolated_cluster", "embedding_failed", "embedding_missing", "embedding_stale", "index_stale", "pending_proposals"]


def diag_all(spark, sf_dir):
    """All thirteen rules in one table with their ids; of equal texts the first is named."""
    rows = [QUERIES[f"diag_{r}"](spark, sf_dir) for r in RULES]
    rows += [G.diagnostic(QUERIES[f"diag_{r}"](spark, sf_dir), r, s) for r, s in (("size_outlier", "warning"), ("tag_drift", "info"), ("namespace_outlier", "info"))]
    rows.append(G.diagnostic(QUERIES["diag_exact_duplicate"](spark, sf_dir).select(F.col("first_id").alias("id")), "exact_duplicate", "warning"))
    return G.named_diagnostics(reduce(DataFrame.union, rows))


QUERIES["diag_all"] = diag_all


@query(CONCEPTS, "SELECT content_hash, count(*) AS n, min(id) AS first_id FROM concepts GROUP BY content_hash HAVING count(*) > 1")
def diag_exact_duplicate(spark, sf_dir):
    return G.duplicate_groups(concepts(spark, sf_dir))


@query(CONCEPTS, "SELECT list_sort(list(strlen(body)))[round_even((count(*) - 1) * 0.95, 0)::BIGINT + 1]::BIGINT AS rank_value FROM concepts")
def nearest_rank_p95(spark, sf_dir):
    return G.nearest_rank(concepts(spark, sf_dir).select(F.octet_length("body").cast("long").alias("x")), "x", 0.95)


_ALL = [f"SELECT rule, severity, id FROM ({ORACLES['diag_' + r]})" for r in RULES]
_ALL += [f"SELECT '{r}', '{s}', id FROM ({ORACLES['diag_' + r]})" for r, s in (("size_outlier", "warning"), ("tag_drift", "info"), ("namespace_outlier", "info"))]
_ALL.append(f"SELECT 'exact_duplicate', 'warning', first_id FROM ({ORACLES['diag_exact_duplicate']})")
ORACLES["diag_all"] = "SELECT severity, rule, 'diagnostic:' || rule || ':' || substr(sha256(rule || chr(0) || id), 1, 16) AS diagnostic_id, id FROM (" + " UNION ALL ".join(_ALL) + ")"
