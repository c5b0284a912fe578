"""The link graph: resolution, degrees, bounded neighbourhoods, clusters and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranks import median, quantiles
from quarry.operators.tables import components, cut, numbered

#: Part of the text that positions are made of.
LAYOUT = "layout-1"
TURN = 6.283185307179586


def resolve(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links with target_id, null where no node has the path (broken)."""
    return links.join(nodes.select(F.col("path").alias("target_path"), F.col("id").alias("target_id")), "target_path", "left")


def spaced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (source_id, target_path) with target_id as by resolve(), and source_namespace and target_namespace; null where there is no node.

    A path's id and namespace come by one join of the nodes among themselves, so the links, which are many more, are joined twice and not three times.
    Nodes are (id, namespace): an id in several namespaces gives a link for each.
    """
    spaces = nodes.select("id", "namespace").distinct()
    places = nodes.select("id", F.col("path").alias("target_path")).join(spaces, "id").select("target_path", F.col("id").alias("target_id"), F.col("namespace").alias("target_namespace"))
    found = links.join(places.hint("shuffle_hash"), "target_path", "left")
    return found.join(spaces.select(F.col("id").alias("source_id"), F.col("namespace").alias("source_namespace")).hint("shuffle_hash"), "source_id", "left")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, inbound, outbound, broken, orphan): all links count outbound; those without a target are broken.

    One union of both ends and one aggregation, so a node with many links is summed before the shuffle.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = links.select(F.col("source_id").alias("id"), zero.alias("i"), one.alias("o"), F.col("target_id").isNull().cast("long").alias("b"))
    ends = ends.union(links.where("target_id is not null").select("target_id", one, zero, zero)).union(nodes.select("id", zero, zero, zero))
    out = ends.groupBy("id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.sum("b").alias("broken"))
    return out.join(nodes.select("id"), "id", "left_semi").withColumn("orphan", (F.col("inbound") == 0) & (F.col("outbound") == 0))


def scoped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose ends are all among the nodes, or broken."""
    inside = links.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    broken = inside.where("target_id is null")
    return inside.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*links.columns).union(broken.select(*links.columns))


def reach(links: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(start, id, depth): nodes within `depth` (at most 2) links of each start, at their least depth, the start left out."""
    a, b = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    steps = links.where("target_id is not null").select(F.col(a).alias("at"), F.col(b).alias("id")).distinct()
    seen = front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    for d in range(1, max(0, min(depth, 2)) + 1):
        new = front.select("start", F.col("id").alias("at")).join(steps, "at").select("start", "id").distinct()
        front = new.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen.where("depth > 0")


def clusters(nodes: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """(id, cluster): components, of which the limit - 1 largest keep their name and the rest are one, overflow."""
    named = nodes.select("id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = named.groupBy("root").agg(F.count("*").alias("size"))
    # only the largest are ranked: a bounded top list, not a window over all
    top = sizes.orderBy(F.desc("size"), "root").limit(limit - 1).select("root", F.col("root").alias("cluster"))
    return named.join(F.broadcast(top), "root", "left").select("id", F.coalesce("cluster", F.lit("overflow")).alias("cluster"))


def between(links: DataFrame, members: DataFrame, most: int = 20_000) -> DataFrame:
    """(source, target, links): counts of links between different clusters.

    Where links are spaced() and members, unique, have a namespace, links are counted by their namespaces first, and joined by id only if one end's
    namespace has several clusters. `most` namespaces, those of most members, go to all tasks; links of any other are joined by id too.
    """
    ends = ["source", "target"]
    if not {"source_namespace", "target_namespace"} <= set(links.columns) or "namespace" not in members.columns:
        for x in ends:
            links = links.join(members.select(F.col("id").alias(f"{x}_id"), F.col("cluster").alias(x)), f"{x}_id")
        return links.where("source <> target").groupBy(*ends).agg(F.count("*").alias("links"))
    spaces = members.groupBy("namespace").agg(F.count("*").alias("n"), F.min("cluster").alias("cluster"), F.max("cluster").alias("last"))
    spaces = cut(spaces, "spaces")
    whole = cut(spaces.where("cluster = last").orderBy(F.desc("n"), "namespace").limit(most).select("namespace", "cluster"), "whole")
    one = {x: whole.select(F.col("namespace").alias(f"{x}_namespace"), F.col("cluster").alias(x)) for x in ends}
    out = links.groupBy("source_namespace", "target_namespace").agg(F.count("*").alias("n"))
    for x in ends:
        out = out.join(F.broadcast(one[x]), f"{x}_namespace")
    if spaces.count() > whole.count():
        rest = links.select("source_id", "source_namespace", "target_id", "target_namespace")
        for x in ends:
            rest = rest.join(F.broadcast(one[x]), f"{x}_namespace", "left")
        rest = rest.where("source is null or target is null").drop(*ends)
        for x in ends:
            rest = rest.join(members.select(F.col("id").alias(f"{x}_id"), F.col("namespace").alias(f"{x}_namespace"), F.col("cluster").alias(x)), [f"{x}_id", f"{x}_namespace"])
        out = out.select(*ends, "n").union(rest.groupBy(*ends).agg(F.count("*").alias("n")))
    return out.where("source <> target").groupBy(*ends).agg(F.sum("n").alias("links"))


def tag_chain(concepts: DataFrame) -> DataFrame:
    """(tag, a, b): within each tag, each concept and the next by id. A frequent tag is many tasks' work: each row meets the one of the next number."""
    tags = numbered(concepts.select(F.explode("tags").alias("tag"), F.col("id").alias("a")), ["tag"], ["a"], "n")
    tags = cut(tags, "tags")
    return tags.join(tags.select("tag", F.col("a").alias("b"), (F.col("n") - 1).alias("n")), ["tag", "n"]).select("tag", "a", "b")


def greedy_edges(edges: DataFrame, most: int) -> DataFrame:
    """Those of edges (id, a, b, similarity) that a walk in order of similarity, then id, takes when no node may have more than `most`.

    Edges are taken in rounds. One that is among the first of both its ends, of the edges still open there, no further down than places are left,
    is taken by the walk too, whatever becomes of those before it; an end without places closes its edges. The first open edge
    of all is always taken, so each round takes some. Only an end's first `most` open edges are looked at. Ids are keys; an edge from a node
    to itself takes two of its places.
    """
    if most < 1:
        return edges.limit(0)
    taken, open_ = edges.limit(0), cut(edges.withColumns({"_a": F.lit(most), "_b": F.lit(most)}), "edges")
    while True:
        ends = open_.select("id", "similarity", F.col("a").alias("node"), F.col("_a").alias("places")).union(open_.select("id", "similarity", "b", "_b"))
        first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "id"))
        ok = ends.withColumn("r", first).where(F.col("r") <= most).where("r <= places").groupBy("id").agg(F.count("*").alias("k")).where("k = 2")
        new = cut(open_.join(ok.select("id"), "id", "left_semi").select(*edges.columns), "taken")
        taken = taken.union(new)
        used = new.select(F.col("a").alias("node")).union(new.select("b")).groupBy("node").agg(F.count("*").cast("int").alias("used"))
        rest = open_.join(new.select("id"), "id", "left_anti")
        for x in "ab":
            rest = rest.join(used.select(F.col("node").alias(x), F.col("used").alias("u")), x, "left").withColumn("_" + x, F.col("_" + x) - F.coalesce("u", F.lit(0))).drop("u")
        open_ = cut(rest.where("_a > 0 and _b > 0").select(*edges.columns, "_a", "_b"), "open")
        if open_.isEmpty():
            return taken


def namespace_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, namespace, root, number, size): groups of nodes by links inside their namespace, each by its least id and its number in the namespace.

    A namespace with several groups, at least half of them of one node, is one group of number 0. Links across namespaces, broken ones and
    those of unknown nodes join nothing. Links that are spaced() have their namespaces already.
    """
    space = nodes.select("id", "namespace").distinct()
    inner = links.where("target_id is not null")
    for end in ("source", "target"):
        if f"{end}_namespace" not in links.columns:
            inner = inner.join(space.select(F.col("id").alias(f"{end}_id"), F.col("namespace").alias(f"{end}_namespace")), f"{end}_id")
    inner = inner.where("source_namespace = target_namespace")
    roots = components(inner.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    named = cut(space.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    groups = named.groupBy("namespace", "root").agg(F.count("*").alias("size"))
    spaces = groups.groupBy("namespace").agg(F.sum("size").alias("all"), F.min("root").alias("least"), (F.count("*") > 1).alias("many"), F.avg((F.col("size") == 1).cast("int")).alias("single"))
    sparse = F.col("many") & (F.col("single") >= 0.5)
    counted = numbered(groups, ["namespace"], ["root"], "number").join(spaces, "namespace")
    one = counted.select("namespace", "root", F.when(sparse, F.col("least")).otherwise(F.col("root")).alias("group"), F.when(sparse, 0).otherwise(F.col("number") - 1).alias("number"), F.when(sparse, F.col("all")).otherwise(F.col("size")).alias("size"))
    return named.join(one, ["namespace", "root"]).select("id", "namespace", F.col("group").alias("root"), "number", "size")


def layout(nodes: DataFrame, links: DataFrame, limit: int = 500) -> DataFrame:
    """(id, namespace, cluster): the cluster of each node, `limit` of them at most.

    Clusters are namespace_groups(). Their ids hold the namespace, the number and a digest of the namespace, the number of members and the
    least and greatest digests of their ids, so the same members give the same id in any order, and a change of members another. Beyond the limit the largest
    limit - 1 stay, and the rest are cluster:overflow.
    """
    groups = cut(namespace_groups(nodes, links), "groups")
    digest = F.sha2("id", 256)
    ids = groups.groupBy("namespace", "root", "number").agg(F.count("*").alias("size"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    short = F.substring(F.sha2(F.concat_ws("\0", "namespace", F.col("size").cast("string"), "low", "high"), 256), 1, 12)
    label = F.coalesce(F.nullif(F.btrim("namespace", F.lit("/")), F.lit("")), F.lit("root"))
    ids = cut(ids.select("namespace", "root", "size", F.concat_ws(":", F.lit("cluster"), label, F.col("number").cast("string"), short).alias("cluster")), "clusters")
    if ids.count() > limit:
        top = ids.orderBy(F.desc("size"), "cluster").limit(limit - 1).select("cluster", F.lit(True).alias("kept"))
        ids = ids.join(F.broadcast(top), "cluster", "left").withColumn("cluster", F.when(F.col("kept"), F.col("cluster")).otherwise("cluster:overflow"))  # limit rows
    return groups.join(ids.select("namespace", "root", "cluster"), ["namespace", "root"]).select("id", "namespace", "cluster")


def unit(text: Column, first: int) -> Column:
    """Four bytes of a digest in hex, from its digit `first` on, as a number from 0 to 1."""
    return F.conv(F.substring(text, first, 8), 16, 10).cast("double") / 2.0**32


def placed(clusters: DataFrame, revision: str) -> DataFrame:
    """clusters (cluster and more) with ordinal, total, x, y and z: on a circle in order of the id, moved a little by digests, the same for a revision."""
    total = clusters.count()
    rows = numbered(clusters, [], ["cluster"], "ordinal").withColumns({"ordinal": F.col("ordinal") - 1, "total": F.lit(total)})
    digest = F.sha2(F.concat_ws("\0", F.lit(LAYOUT), F.lit(revision), "cluster"), 256)
    angle = TURN * (F.col("ordinal") + 0.5 + (unit(digest, 1) - 0.5) * 0.2) / max(1, total)
    radius = 3.0 + max(1, total) ** 0.5 * 0.6
    return rows.withColumns({"x": F.cos(angle) * radius, "y": F.sin(angle) * radius, "z": (unit(digest, 9) - 0.5) * 2.0})


def diagnostic(rows: DataFrame, rule: str, severity: str) -> DataFrame:
    """(rule, severity, id): one row for each concept that a rule names; the severities sort as words."""
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "id")


def named_diagnostics(rows: DataFrame) -> DataFrame:
    """(severity, rule, diagnostic_id, id) of (rule, severity, id): ids are made of the rule and the concept, so they stay from run to run."""
    digest = F.substring(F.sha2(F.concat("rule", F.lit("\0"), "id"), 256), 1, 16)
    return rows.select("severity", "rule", F.concat(F.lit("diagnostic:"), "rule", F.lit(":"), digest).alias("diagnostic_id"), "id")


def stale(now: DataFrame, had: DataFrame) -> DataFrame:
    """(id) of now (id, hash) that had (id, hash) holds with another hash, or not at all: a revision against what was made of one."""
    known = had.select("id", F.col("hash").alias("_had"))
    return now.join(known, "id", "left").where(~F.col("hash").eqNullSafe(F.col("_had"))).select("id")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets' elements the share that both have; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def duplicate_groups(concepts: DataFrame) -> DataFrame:
    """(content_hash, n, first_id): texts that several concepts have."""
    return concepts.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def size_outliers(concepts: DataFrame, least: int = 4) -> DataFrame:
    """(id, namespace, size): sizes over the namespace's median plus the greater of 1024 and six median deviations.

    Medians are found by selection, so no task holds a namespace's sizes. They go to all tasks where namespaces are few. Null bodies have no
    size in bytes; rows of a null namespace are left out.
    """
    rows = concepts.where("namespace is not null").select("id", "namespace", F.octet_length("body").cast("double").alias("size"))
    mid = cut(median(rows, "size", "namespace").where(F.col("n") >= least), "medians")
    few = F.broadcast if mid.count() <= 20_000 else (lambda df: df)
    off = rows.join(few(mid.select("namespace", "mid")), "namespace").withColumn("off", F.abs(F.col("size") - F.col("mid")))
    mad = median(off, "off", "namespace").select("namespace", F.col("mid").alias("mad"))
    return off.join(few(mad), "namespace").where(F.col("size") > F.col("mid") + F.greatest(F.lit(1024.0), 6 * F.col("mad"))).select("id", "namespace", F.col("size").cast("long").alias("size"))


def tag_drift(concepts: DataFrame, share: float = 0.75, least: int = 4) -> DataFrame:
    """(id, missing): concepts without a tag that most of their namespace have; missing is joined by commas."""
    sizes = concepts.groupBy("namespace").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    tags = concepts.select("namespace", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("namespace", "tag").agg(F.count("*").alias("n"))
    common = tags.join(sizes, "namespace").where(F.col("n") >= share * F.col("size")).groupBy("namespace").agg(F.collect_list("tag").alias("common"))
    rows = concepts.join(common, "namespace").select("id", F.array_sort(F.array_except("common", "tags")).alias("m")).where(F.size("m") > 0)
    return rows.select("id", F.array_join("m", ",").alias("missing"))


def nearest_rank(rows: DataFrame, value: str, fraction: float) -> DataFrame:
    """(rank_value): the value at place bround((n - 1) * fraction) in order, found by selection; null of no values."""
    return quantiles(rows, value, [fraction], nearest=True).agg(F.max("x").alias("rank_value"))  # of one row


def namespace_outliers(nodes: DataFrame, links: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """(id, linked, outside): nodes most of whose neighbours, by links either way, lie in other namespaces."""
    good = links.where("target_id is not null").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    both = good.union(good.select("other", "id"))
    space = nodes.select("id", F.col("namespace").alias("own"))
    rows = both.join(space, "id").join(space.select(F.col("id").alias("other"), F.col("own").alias("theirs")), "other")
    out = rows.groupBy("id").agg(F.count("*").alias("linked"), F.count_if(F.col("own") != F.col("theirs")).alias("outside"))
    return out.where((F.col("linked") >= least) & (F.col("outside") >= share * F.col("linked")))


def selection(nodes: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with degrees, links) of what ids (id) select: links with both ends inside, degrees counted from these alone.

    Repeated ids select once; unknown and null ones select nothing. Links without a target are outside.
    """
    inside = nodes.select("id").join(ids.select("id"), "id", "left_semi")
    kept = links.where("target_id is not null").join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return degrees(inside, kept), kept


def pages(members: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """(cluster, page, nodes, first, last, links) of members (id, cluster): pages of `size` members by id, with the links that lie in one page whole.

    A cluster of any size is many tasks' work: members are numbered by ranges. Ids are unique; null ids are left out.
    """
    paged = numbered(members.where("id is not null").select("id", "cluster"), ["cluster"], ["id"], "_n")
    paged = paged.select("id", "cluster", F.floor((F.col("_n") - 1) / size).alias("page"))
    end = lambda x: paged.select(F.col("id").alias(f"{x}_id"), F.struct("cluster", "page").alias(x))
    inner = links.where("target_id is not null").select("source_id", "target_id").join(end("source"), "source_id").join(end("target"), "target_id")
    inner = inner.where(F.col("source").eqNullSafe(F.col("target"))).groupBy(F.col("source.cluster").alias("_c"), F.col("source.page").alias("_p")).agg(F.count("*").alias("links"))
    out = paged.groupBy("cluster", "page").agg(F.count("*").alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))
    same = F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("page") == F.col("_p"))
    return out.join(inner, same, "left").select("cluster", "page", "nodes", "first", "last", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def paths_in_order(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, paths): the paths of each request's ids (array), in the ids' order; unknown and null ids are dropped, repeated ones stay.

    Requests are unique. One without known ids, or with null ids, has an empty list. An id's path joins by id, so a list's length is all that a task holds.
    """
    asked = requests.select("request", F.posexplode("ids").alias("_pos", "id"))
    found = asked.join(nodes.select("id", "path"), "id").groupBy("request").agg(F.sort_array(F.collect_list(F.struct("_pos", "path"))).alias("_f"))
    none = F.array().cast("array<string>")
    return requests.select("request").join(found, "request", "left").select("request", F.coalesce(F.col("_f.path"), none).alias("paths"))
