"""Queries: concepts, filters, lexical, semantic and hybrid search, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import ACCENTED, PLAIN, reserved, snippet
from quarry.operators import index as I
from quarry.operators import search as S
from quarry.operators.tables import run_dir
from quarry.plans.registry import CONCEPTS, VECTORS, registry, tokens_sql
from quarry.sources.tables import concepts, table, vectors

QUERIES, ORACLES, query = registry()
PREFIXES = ["/src0/", "/src1/", "/src2/"]
SCOPE = "(" + " OR ".join(f"starts_with(path, '{p}')" for p in PREFIXES) + ")"
COLUMNS = ["id", "path", "type", "title", "status"]


@query(CONCEPTS, f"SELECT id, path, type, title, status FROM concepts WHERE {SCOPE}")
def concept_list_scoped(spark, sf_dir):
    return concepts(spark, sf_dir).where(S.visible(PREFIXES)).select(*COLUMNS)


@query(CONCEPTS, "SELECT id, path, type, status, body FROM concepts WHERE id = 'doc-00000042'")
def concept_point_read(spark, sf_dir):
    return concepts(spark, sf_dir).where(F.col("id") == "doc-00000042").select("id", "path", "type", "status", "body")


@query(CONCEPTS, f"SELECT count(*) FILTER ({SCOPE}) AS seen, count(*) AS total FROM concepts")
def visible_count(spark, sf_dir):
    return concepts(spark, sf_dir).agg(F.count_if(S.visible(PREFIXES)).alias("seen"), F.count("*").alias("total"))


@query(CONCEPTS, "SELECT id, path FROM concepts WHERE type = 'person' AND status = 'active' AND list_contains(tags, 'en') AND list_contains(tags, 'person')")
def filter_type_status_tags(spark, sf_dir):
    return S.filtered(concepts(spark, sf_dir), kind="person", status="active", tags=("en", "person")).select("id", "path")


@query(CONCEPTS, "SELECT id, path FROM concepts WHERE starts_with(path, '/src1/en/')")
def filter_path_prefix(spark, sf_dir):
    return S.filtered(concepts(spark, sf_dir), prefix="/src1/en/").select("id", "path")


@query("""p AS (SELECT url || CASE page_id % 4 WHEN 0 THEN '/index.md' WHEN 1 THEN '/.memory-schema.json' ELSE '/a.md' END AS path FROM pages
  UNION ALL SELECT '/log.md' UNION ALL SELECT '/.assets/x/1.0.0.json' UNION ALL SELECT '/projects/log.md')""",
       r"SELECT path FROM p WHERE NOT (starts_with(path, '/.assets/') OR regexp_matches(path, '(^|/)(index\.md|\.memory-schema\.json)$') OR path = '/log.md')")
def reserved_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    end = F.when(F.col("page_id") % 4 == 0, "/index.md").when(F.col("page_id") % 4 == 1, "/.memory-schema.json").otherwise("/a.md")
    more = spark.createDataFrame([("/log.md",), ("/.assets/x/1.0.0.json",), ("/projects/log.md",)], "path string")
    return p.select(F.concat("url", end).alias("path")).union(more).where(~reserved(F.col("path")))


def bm25_sql(terms: list[str], every: bool = False, scope: str = "TRUE", stats: str = "TRUE", end: str = "ORDER BY score DESC, id LIMIT 20") -> tuple[str, ...]:
    fields = {"title": ("title", 5.0), "tags": ("array_to_string(tags, ' ')", 1.0), "body": ("body", 5.0), "path": ("path", 1.0)}
    toks = ", ".join(f"{tokens_sql(x)} AS t{f}" for f, (x, _) in fields.items())
    w = ", ".join("(" + " + ".join(f"{wt}::DOUBLE * len(list_filter(t{f}, lambda x: x = '{t}'))" for f, (_, wt) in fields.items()) + f") AS w{i}" for i, t in enumerate(terms))
    n = range(len(terms))
    hit = (" AND " if every else " OR ").join(f"w{i} > 0" for i in n)
    score = " + ".join(f"greatest(ln((N - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * w{i} * 2.2::DOUBLE / (w{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in n)
    return (
        CONCEPTS,
        f"tok AS (SELECT id, path, {toks} FROM concepts)",
        f"cnt AS (SELECT id, path, (len(ttitle) + len(ttags) + len(tbody) + len(tpath))::DOUBLE AS dl, {w} FROM tok)",
        f"st AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (w{i} > 0)::DOUBLE AS n{i}' for i in n)} FROM cnt WHERE {stats})",
        f"SELECT id, path, round(score, 6) AS score FROM (SELECT id, path, {score} AS score FROM cnt, st WHERE {scope} AND ({hit})) {end}",
    )


def indexed(spark, sf_dir):
    """The index of the concepts: made once in an application for the same files, as a service keeps it, and read by all searches."""
    files = table(spark, sf_dir, "documents").select("_metadata.*").union(table(spark, sf_dir, "labels").select("_metadata.*"))
    seen = files.select(F.xxhash64("file_path", "file_size", "file_modification_time").alias("h")).distinct().agg(F.expr("bit_xor(h)")).first()[0]
    root = f"{run_dir(spark)}/index-{seen}"
    return I.opened(spark, root) or I.build(concepts(spark, sf_dir), root)


@query(CONCEPTS, f"SELECT count(*) AS docs, sum(len({tokens_sql('title')}) + len({tokens_sql('body')}) + len({tokens_sql('path')}) + len({tokens_sql("array_to_string(tags, ' ')")}))::BIGINT AS words FROM concepts")
def index_build(spark, sf_dir):
    i = indexed(spark, sf_dir)
    return i.docs().agg(F.count("*").alias("docs"), F.sum("size").alias("words"))


def ranked(rows):
    return rows.select("id", "path", F.round("score", 6).alias("score"))


@query(*bm25_sql(["from", "license", "with"]))
def bm25_plain_or(spark, sf_dir):
    return ranked(S.page(I.scores(indexed(spark, sf_dir), ["from", "license", "with"]), [F.desc("score"), F.col("id")]))


@query(*bm25_sql(["from", "with", "that"], every=True))
def bm25_and(spark, sf_dir):
    return ranked(S.page(I.scores(indexed(spark, sf_dir), ["from", "with", "that"], every=True), [F.desc("score"), F.col("id")]))


@query(*bm25_sql(["from", "with"], end="ORDER BY score DESC, id LIMIT 10 OFFSET 10"))
def bm25_page2(spark, sf_dir):
    return ranked(S.page(I.scores(indexed(spark, sf_dir), ["from", "with"]), [F.desc("score"), F.col("id")], limit=10, offset=10))


@query(*bm25_sql(["from", "with"], scope=SCOPE, stats=SCOPE))
def bm25_scoped_stats(spark, sf_dir):
    return ranked(S.page(I.scores(indexed(spark, sf_dir), ["from", "with"], prefixes=PREFIXES, scoped_stats=True), [F.desc("score"), F.col("id")]))


@query(*bm25_sql(["from", "with"], scope=SCOPE))
def bm25_global_stats(spark, sf_dir):
    return ranked(S.page(I.scores(indexed(spark, sf_dir), ["from", "with"], prefixes=PREFIXES), [F.desc("score"), F.col("id")]))


_FOUND = bm25_sql(["from", "license", "from"], scope=SCOPE + " AND id IN (SELECT id FROM concepts WHERE status = 'active' AND list_contains(tags, 'en'))", end="")


@query(*_FOUND[:-1], f"found AS ({_FOUND[-1].replace('round(score, 6)', 'score')})", "ahead AS (SELECT id, score FROM found ORDER BY score DESC, id LIMIT 6 OFFSET 5)",
       "SELECT id, round(score, 6) AS score, place::INT AS place, has_next FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place, count(*) OVER () > 5 AS has_next FROM ahead) WHERE place <= 5")
def search_page(spark, sf_dir):
    i, asked = indexed(spark, sf_dir), "From: license, FROM!"
    out = S.search(i.docs(), asked, limit=5, offset=5, prefixes=PREFIXES, lexical=I.scores(i, S.plain_terms(asked), prefixes=PREFIXES), status="active", tags=("en",))
    return out.select("id", F.round("score", 6).alias("score"), "place", "has_next")


@query(CONCEPTS, f"SELECT t AS term, count(*) AS df, sum(c)::BIGINT AS tf FROM (SELECT id, t, count(*) AS c FROM (SELECT id, unnest({tokens_sql('body')}) AS t FROM concepts) GROUP BY id, t) GROUP BY t")
def body_vocabulary(spark, sf_dir):
    p = indexed(spark, sf_dir).postings().where("tf_body > 0")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf_body").cast("long")).alias("tf"))


def many_sql(every: bool, k: int, scope: str = "TRUE") -> tuple[str, ...]:
    words = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"
    kept = f"list_filter({words}, lambda w: NOT list_contains({I.QUERY_STOP_WORDS}, lower(w)))"
    chosen = words if every else f"CASE WHEN len({kept}) > 0 THEN list_distinct({kept}) ELSE list_distinct({words}) END"
    fields = {"title": ("title", 5), "tags": ("array_to_string(tags, ' ')", 1), "body": ("body", 5), "path": ("path", 1)}
    each = " UNION ALL ".join(f"SELECT id, unnest({tokens_sql(x)}) AS term, {w}::DOUBLE AS w FROM concepts" for x, w in fields.values())
    return (
        CONCEPTS,
        f"asked AS (SELECT conv_id || ':' || turn AS qid, unnest({chosen}) AS word FROM conversations WHERE role = 'user')",
        f"qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({tokens_sql('word')}) AS term FROM asked) GROUP BY qid, term)",
        "need AS (SELECT qid, count(*) AS terms FROM qt GROUP BY qid)",
        f"each_term AS ({each})",
        "post AS (SELECT id, term, sum(w) AS w FROM each_term GROUP BY id, term)",
        "size AS (SELECT id, count(*)::DOUBLE AS dl FROM each_term GROUP BY id)",
        "st AS (SELECT (SELECT count(*) FROM concepts)::DOUBLE AS n, (SELECT sum(dl) FROM size) / (SELECT count(*) FROM concepts) AS mean)",
        "dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)",
        f"hit AS (SELECT qid, id, count(*) AS hits, round(sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * w * 2.2::DOUBLE / (w + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 10) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN size USING (id) JOIN concepts USING (id), st WHERE {scope} GROUP BY qid, id)",
        f"SELECT qid, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hit {'JOIN need USING (qid) WHERE hits = terms' if every else ''}) WHERE rank <= {k}",
    )


def questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")


@query(*many_sql(False, 10))
def search_questions(spark, sf_dir):
    """All questions of the conversations, plain: any of their words but stop words."""
    out = I.search_many(indexed(spark, sf_dir), questions(spark, sf_dir), 10)
    return out.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(*many_sql(True, 20, SCOPE))
def search_box(spark, sf_dir):
    """All questions as the graph's search box takes them: every word, in scope."""
    out = I.search_many(indexed(spark, sf_dir), questions(spark, sf_dir), 20, every=True, prefixes=PREFIXES)
    return out.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(CONCEPTS, f"each_term AS ({' UNION ALL '.join(f'SELECT id, unnest({tokens_sql(x)}) AS term FROM concepts' for x in ('title', 'body', 'path', chr(34).join(('array_to_string(tags, ', ')')).replace(chr(34), chr(39) + ' ' + chr(39))))})",
       "SELECT 'docs' AS name, count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM concepts UNION ALL SELECT 'postings', count(*), count(*), 0, 0 FROM (SELECT DISTINCT id, term FROM each_term) UNION ALL SELECT 'statistics', 1, 1, 0, 0")
def index_parity(spark, sf_dir):
    """An index of an older revision brought to this one by two updates, against one made anew.

    The older revision lacks concepts, has others' bodies, and has some that are gone; all concepts are in the comparison.
    """
    from uuid import uuid4

    now = concepts(spark, sf_dir)
    old = now.where("doc_id % 11 <> 0").withColumn("body", F.when(F.col("doc_id") % 13 == 0, F.reverse("body")).otherwise(F.col("body")))
    lost = now.where("doc_id % 17 = 0").withColumns({"id": F.concat(F.lit("old-"), "id"), "path": F.concat(F.lit("/old"), "path")})
    anew = indexed(spark, sf_dir)
    i = I.build(old.unionByName(lost), f"{run_dir(spark)}/index-{uuid4().hex}", anew.buckets)  # so that buckets meet
    i = I.update(i, now.where("doc_id % 13 = 0"), lost.select("id"))
    i = I.update(i, now.where("doc_id % 11 = 0"), now.limit(0).select("id"))
    return I.parity(i, anew)


@query(CONCEPTS, r"SELECT id, substr(trim(regexp_replace(body, '\s+', ' ', 'g')), 1, 240) AS snippet FROM concepts WHERE status = 'active'")
def snippets(spark, sf_dir):
    return concepts(spark, sf_dir).where("status = 'active'").select("id", snippet(F.col("body")).alias("snippet"))


ASKED = [round(((i * 37) % 17 - 8) / 8, 3) for i in range(64)]
ASKED_SQL = "[" + ", ".join(f"{x}" for x in ASKED) + "]::DOUBLE[]"


@query(VECTORS, f"SELECT id, round(list_cosine_similarity(v, {ASKED_SQL}), 6) AS cosine FROM vectors WHERE status = 'ready' ORDER BY list_cosine_similarity(v, {ASKED_SQL}) DESC, id LIMIT 20")
def semantic_topk(spark, sf_dir):
    out = S.page(S.semantic(vectors(spark, sf_dir), ASKED), [F.desc("cosine"), F.col("id")])
    return out.select("id", F.round("cosine", 6).alias("cosine"))


@query(VECTORS, CONCEPTS, f"SELECT id, round(c, 6) AS cosine FROM (SELECT v.id, path, list_cosine_similarity(v, {ASKED_SQL}) AS c FROM vectors v JOIN concepts USING (id) WHERE v.status = 'ready' ORDER BY path, id LIMIT 200) ORDER BY c DESC, path, id LIMIT 20")
def semantic_path_cap(spark, sf_dir):
    v = vectors(spark, sf_dir).where("status = 'ready'").join(concepts(spark, sf_dir).select("id", "path"), "id").orderBy("path", "id").limit(200)
    return S.page(S.semantic(v, ASKED), [F.desc("cosine"), F.col("path"), F.col("id")]).select("id", F.round("cosine", 6).alias("cosine"))


_LEX = bm25_sql(["from", "with"], end="")


@query(*_LEX[:-1], VECTORS,
       "lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (" + _LEX[-1].replace("round(score, 6)", "score") + ") ORDER BY score DESC, id LIMIT 200)",
       f"sem AS (SELECT id, c, row_number() OVER (ORDER BY c DESC, id) AS r FROM (SELECT id, list_cosine_similarity(v, {ASKED_SQL}) AS c FROM vectors WHERE status = 'ready') ORDER BY c DESC, id LIMIT 200)",
       "SELECT s.id, s.r::INT AS semantic_rank, l.r::INT AS lexical_rank, round(coalesce(0.5::DOUBLE / (60 + l.r), 0) + 1.0::DOUBLE / (60 + s.r), 9) AS fused FROM sem s LEFT JOIN lex l ON s.id = l.id ORDER BY fused DESC, c DESC, s.id LIMIT 20")
def hybrid_rrf(spark, sf_dir):
    out = S.hybrid(I.scores(indexed(spark, sf_dir), ["from", "with"]), S.semantic(vectors(spark, sf_dir), ASKED))
    out = out.withColumn("fused", F.round("fused", 9))
    return S.page(out, [F.desc("fused"), F.desc("cosine"), F.col("id")]).select("id", "semantic_rank", "lexical_rank", "fused")


@query(VECTORS, "SELECT id, len(v)::INT AS dims, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM vectors")
def vector_dims_norm(spark, sf_dir):
    v = F.col("embedding")
    return vectors(spark, sf_dir).select("id", F.size(v).alias("dims"), F.round(F.sqrt(S.dot(v, v)), 5).alias("norm"))


@query(VECTORS, "SELECT id, len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0 AS valid FROM vectors")
def vector_valid(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", S.valid_vector(F.col("embedding")).alias("valid"))


NEAREST = """nearest AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.status = 'ready' AND b.status = 'ready' AND list_cosine_similarity(a.v, b.v) >= 0.5) WHERE r <= 5)"""


@query(VECTORS, NEAREST, "SELECT a, b, r::INT AS rank, round(c, 6) AS cosine FROM nearest")
def knn_per_node(spark, sf_dir):
    return S.neighbours(vectors(spark, sf_dir), 0.5, 5).select("a", "b", "rank", F.round("cosine", 6).alias("cosine"))


@query(VECTORS, NEAREST, "SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(c), 6) AS cosine, count(*) = 2 AS mutual FROM nearest GROUP BY least(a, b), greatest(a, b)")
def mutual_knn_edges(spark, sf_dir):
    return S.mutual(S.neighbours(vectors(spark, sf_dir), 0.5, 5)).select("a", "b", F.round("cosine", 6).alias("cosine"), "mutual")


@query("SELECT label, i::INT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def centroid_by_label(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


assert len(ACCENTED) == len(PLAIN)
