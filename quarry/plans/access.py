"""Queries: policies, changes judged by them, recovery after a crash, and stored vectors brought up to date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import access as A
from quarry.operators import embeddings as E
from quarry.plans.corpus import VERSIONS, versions
from quarry.plans.graph import OLDER, older
from quarry.plans.registry import CONCEPTS, EVENTS, PROPOSALS, VECTORS, registry
from quarry.sources.tables import concepts, events, proposals, vectors

QUERIES, ORACLES, query = registry()

# Users hold the kinds of their events as roles. Their policies ask for "view", every third's also for "admin"; they write where they have 12 events and more.
POLICIES = """held AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS roles FROM ev GROUP BY user_id),
wide AS (SELECT user_id, list_sort(list(prefix)) AS prefixes FROM (SELECT user_id, '/' || event_type || '/' AS prefix FROM ev GROUP BY user_id, event_type HAVING count(*) >= 12) GROUP BY user_id),
policies AS (SELECT h.user_id AS principal, CASE WHEN h.user_id % 10 = 9 THEN 'unknown principal' WHEN h.user_id % 7 = 3 THEN 'missing required roles: admin' || CASE WHEN list_contains(roles, 'view') THEN '' ELSE ', view' END WHEN NOT list_contains(roles, 'view') THEN 'missing required roles: view' END AS refused,
  coalesce(prefixes, []) AS prefixes FROM held h LEFT JOIN wide USING (user_id))"""


def policies(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type")
    held = e.groupBy(F.col("user_id").alias("principal")).agg(F.collect_set("event_type").alias("held"))
    often = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 12")
    wide = often.groupBy(F.col("user_id").alias("principal")).agg(F.sort_array(F.collect_list(F.concat(F.lit("/"), "event_type", F.lit("/")))).alias("write_prefixes"))
    asked = F.when(F.col("principal") % 7 == 3, F.array(F.lit("view"), F.lit("admin"))).otherwise(F.array(F.lit("view")))
    known = held.where("principal % 10 <> 9").select("principal", asked.alias("roles"), F.array(F.lit("/")).alias("read_prefixes")).join(wide, "principal", "left")
    return A.resolved(held, known.withColumn("write_prefixes", F.coalesce("write_prefixes", F.array().cast("array<string>"))))


@query(EVENTS, POLICIES, "SELECT principal, refused, CASE WHEN refused IS NULL THEN array_to_string(prefixes, ' ') ELSE '' END AS may_write FROM policies")
def policy_resolution(spark, sf_dir):
    return policies(spark, sf_dir).select("principal", "refused", F.array_join("write_prefixes", " ").alias("may_write"))


# Each event proposes a change of its key's file in its kind's folder and, but for errors, a second one; purchases rename to where clicks are.
CHANGES = """asked AS (SELECT event_id AS proposal_id, user_id AS principal, event_type AS kind, '/' || event_type || '/k' || k || '.md' AS path, '/click/k' || k || '.md' AS other FROM ev),
judged AS (SELECT a.*, refused, prefixes,
  CASE kind WHEN 'error' THEN 'unsupported change kind: error' ELSE CASE WHEN NOT list_contains(prefixes, '/' || kind || '/') THEN 'cannot write ' || path WHEN kind = 'purchase' AND NOT list_contains(prefixes, '/click/') THEN 'cannot write ' || other
    WHEN kind <> 'purchase' AND NOT list_contains(prefixes, '/view/') THEN 'cannot write ' || replace(other, '/click/', '/view/') END END AS why
  FROM asked a JOIN policies p USING (principal))"""


def changes(spark, sf_dir):
    e = events(spark, sf_dir)
    path = F.concat(F.lit("/"), "event_type", F.lit("/k"), "k", F.lit(".md"))
    kind = F.when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "error", "error").otherwise("patch")
    first = F.struct(kind.alias("kind"), path.alias("path"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("/click/k"), "k", F.lit(".md"))).alias("new_path"))
    second = F.struct(F.lit("create").alias("kind"), F.concat(F.lit("/view/k"), "k", F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("new_path"))
    listed = F.when(F.col("event_type").isin("purchase", "error"), F.array(first)).otherwise(F.array(first, second))
    return e.select(F.col("event_id").alias("proposal_id"), F.col("user_id").alias("principal"), F.to_json(listed).alias("changes"))


@query(EVENTS, POLICIES, CHANGES, "reasons AS (SELECT proposal_id, kind, CASE WHEN kind = 'error' THEN why ELSE coalesce(refused, why) END AS reason FROM judged)", "SELECT proposal_id, CASE WHEN kind IN ('purchase', 'error') THEN 1 ELSE 2 END::BIGINT AS changes, reason IS NULL AS allowed, reason FROM reasons")
def change_authorisation(spark, sf_dir):
    return A.authorised(A.normalised(changes(spark, sf_dir)), policies(spark, sf_dir), "view")


HEADS = "heads AS (SELECT k, max(event_id) AS head, arg_max(user_id, event_id) AS own, min(event_id) AS first FROM ev WHERE event_type = 'purchase' GROUP BY k)"


@query(EVENTS, HEADS, "SELECT event_id, CASE WHEN head IS NULL THEN 'retryable' WHEN head < event_id AND own = user_id THEN 'published' WHEN first < event_id AND head > event_id THEN 'conflict' ELSE 'retryable' END AS recovery FROM ev LEFT JOIN heads USING (k) WHERE event_type IN ('view', 'signup')")
def recovery_class(spark, sf_dir):
    """Purchases are a key's revisions: an operation began from the last one before it, and its own is the head if its user made that before."""
    e = events(spark, sf_dir)
    heads = e.where("event_type = 'purchase'").groupBy("k").agg(F.max("event_id").alias("head"), F.max_by("user_id", "event_id").alias("own"), F.min("event_id").alias("first"))
    rows = e.where("event_type in ('view', 'signup')").join(heads, "k", "left")
    base = F.when(F.col("head") < F.col("event_id"), F.col("head")).when(F.col("first") < F.col("event_id"), F.col("first"))
    worktree = F.when((F.col("own") == F.col("user_id")) & (F.col("head") < F.col("event_id")), F.col("head"))
    ops = rows.select(F.col("event_id").alias("id"), F.col("k").alias("repository"), base.alias("base"), worktree.alias("worktree"))
    return A.recovered(ops, heads.withColumnRenamed("k", "repository")).withColumnRenamed("id", "event_id")


WANTED = VERSIONS + """, wanted AS (SELECT DISTINCT 'Brand#' || (1 + k % 5) || (1 + author % 5) AS pack, (k % 3) || '.' || (k % 10) || '.' || (k % 7) AS version
  FROM (SELECT p.*, replace(replace(path, '/k', ''), '.md', '')::BIGINT AS k FROM proposals p) WHERE status IN ('submitted', 'approved'))"""


@query(PROPOSALS, WANTED, "SELECT s.pack, s.version, w.version IS NOT NULL AS wanted, w.version IS NOT NULL OR row_number() OVER (PARTITION BY s.pack ORDER BY key DESC) <= 5 AS kept FROM s LEFT JOIN wanted w ON w.pack = s.pack AND w.version = s.version")
def retention_wanted(spark, sf_dir):
    """Versions that stay: the newest five of a pack, and those that open proposals name."""
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    open_ = proposals(spark, sf_dir).where("status in ('submitted', 'approved')").withColumn("k", k)
    wanted = open_.select(F.concat(F.lit("Brand#"), 1 + F.col("k") % 5, 1 + F.col("author") % 5).alias("asset"), F.concat_ws(".", *[(F.col("k") % n).cast("string") for n in (3, 10, 7)]).alias("version")).distinct()
    rows = versions(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("key")))).withColumnRenamed("pack", "asset")
    out = A.pruned_versions(rows, 5, wanted)
    return out.withColumnRenamed("asset", "pack").select("pack", "version", "wanted", "kept")


LETTERS, LONGEST = "aeinorst", 12_000


def letters(texts: list[str]) -> list[list[float]]:
    """A small model: how often a text holds each of eight letters. It takes no text of more than 12,000 characters."""
    for text in texts:
        if len(text) > LONGEST:
            raise ValueError(f"text of {len(text)} characters")
    return [[float(text.count(c)) for c in LETTERS] for text in texts]


def stored(spark, sf_dir):
    """Vectors as an index of the older revision has them: some by the model's revision before, those that failed without a vector."""
    v = vectors(spark, sf_dir).join(older(spark, sf_dir).withColumnRenamed("hash", "text_hash"), "id", "left")
    ready = F.col("status") == "ready"
    return v.select(
        "id", F.lit("/old.md").alias("path"), "text_hash", F.lit("letters").alias("model_id"), F.lit(8).alias("dimensions"), F.when(F.col("label") == 3, "m0").otherwise("m1").alias("model_revision"), F.lit("r1").alias("revision"),
        "status", F.when(ready, F.array(*[F.lit(1.0)] * 8)).alias("vector"), F.when(ready, F.lit(8.0) ** 0.5).alias("norm"), F.lit(None).cast("string").alias("error"),
    )


def model() -> E.Model:
    return E.Model("letters", 8, "m1", letters)


COUNTS = ", ".join(f"(length(body) - length(replace(body, '{c}', '')))::DOUBLE" for c in LETTERS)
REFRESHED = f"""was AS (SELECT v.id, v.status, v.label, o.hash FROM vectors v LEFT JOIN older o ON o.id = v.id),
had AS (SELECT c.id, c.path, c.content_hash, coalesce(w.status = 'ready' AND w.label <> 3 AND w.hash = c.content_hash, false) AS fresh, body FROM concepts c LEFT JOIN was w ON w.id = c.id),
made AS (SELECT id, path, content_hash, fresh, length(body) AS n, CASE WHEN fresh THEN [1, 1, 1, 1, 1, 1, 1, 1]::DOUBLE[] WHEN length(body) <= {LONGEST} THEN [{COUNTS}] END AS v FROM had),
refreshed AS (SELECT id, path, content_hash, fresh, CASE WHEN v IS NULL THEN 'text of ' || n || ' characters' WHEN list_sum(v) = 0 THEN 'a vector without a length' END AS error, v FROM made)"""


@query(CONCEPTS, VECTORS, OLDER, REFRESHED, "SELECT id, path, content_hash AS text_hash, 'm1' AS model_revision, 'r2' AS revision, CASE WHEN error IS NULL THEN 'ready' ELSE 'degraded' END AS status, CASE WHEN error IS NULL THEN array_to_string([x::BIGINT FOR x IN v], ' ') END AS vector, round(CASE WHEN error IS NULL THEN sqrt(list_sum([x * x FOR x IN v])) END, 6) AS norm, error FROM refreshed")
def embedding_refresh(spark, sf_dir):
    c = concepts(spark, sf_dir).select("id", "path", F.col("body").alias("text"))
    out = E.refresh(c, stored(spark, sf_dir), model(), "r2")
    shown = F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), " ")
    return out.select("id", "path", "text_hash", "model_revision", "revision", "status", shown.alias("vector"), F.round("norm", 6).alias("norm"), "error")


@query(CONCEPTS, VECTORS, OLDER, REFRESHED, "SELECT count(*) AS concepts, count(*) FILTER (error IS NULL) AS ready, CASE WHEN count(*) = count(*) FILTER (error IS NULL) THEN 'r2' WHEN count(*) FILTER (error IS NULL) > 0 THEN 'partial' ELSE '' END AS state FROM refreshed")
def embedding_revision(spark, sf_dir):
    c = concepts(spark, sf_dir).select("id", "path", F.col("body").alias("text"))
    return E.embedding_state(c, E.refresh(c, stored(spark, sf_dir), model(), "r2"), "r2")
