"""Queries: operations, proposals, signals, caches, windows and vectors' lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import state as S
from quarry.operators.ranks import quantiles
from quarry.operators.tables import latest, newest
from quarry.plans.registry import CONCEPTS, EVENTS, PROPOSALS, VECTORS, registry
from quarry.sources.tables import concepts, events, proposals, vectors

QUERIES, ORACLES, query = registry()
NOW, DAY = 1704067200 + 12 * 86400, 86400


def requests(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("principal"), F.col("k").alias("key"), F.col("event_type").alias("hash"))


@query(EVENTS, "f AS (SELECT user_id, k, min(event_id) AS first_id, arg_min(event_type, event_id) AS h, count(*) AS n FROM ev GROUP BY user_id, k)", "SELECT f.user_id AS principal, f.k AS key, first_id, n AS requests, (SELECT count(*) FROM ev WHERE ev.user_id = f.user_id AND ev.k = f.k AND ev.event_type <> h) AS conflicts, h AS first_hash FROM f")
def idempotent_ops(spark, sf_dir):
    return S.idempotent(requests(spark, sf_dir))


@query(EVENTS, "SELECT user_id AS principal, k AS key, count(DISTINCT event_type) AS hashes FROM ev GROUP BY user_id, k HAVING count(DISTINCT event_type) > 1")
def idempotency_conflicts(spark, sf_dir):
    rows = requests(spark, sf_dir).groupBy("principal", "key").agg(F.count_distinct("hash").alias("hashes"))
    return rows.where("hashes > 1")


@query(EVENTS, "SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS event_id FROM ev GROUP BY user_id")
def op_latest_state(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.col("event_type").alias("state"), "event_id")
    return latest(e, ["user_id"], ["event_id"]).select("user_id", "state", "event_id")


@query(EVENTS, "SELECT event_id, user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS s, max(event_id) AS event_id FROM ev GROUP BY user_id) WHERE s IN ('view', 'signup')")
def interrupted_ops(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return latest(e, ["user_id"], ["event_id"]).where(F.col("event_type").isin("view", "signup")).select("event_id", "user_id")


@query(PROPOSALS, "SELECT path, count(*) AS total, count(*) FILTER (status IN ('draft', 'submitted', 'approved')) AS pending FROM proposals GROUP BY path")
def proposal_counts(spark, sf_dir):
    return S.proposal_counts(proposals(spark, sf_dir))


@query(PROPOSALS, f"SELECT proposal_id, CASE WHEN moment + {5 * DAY} < {NOW} AND status <> 'applied' THEN 'expired' WHEN status IN ('submitted', 'approved') AND proposal_id % 3 <> 0 THEN 'stale' ELSE status END AS fresh_status FROM proposals")
def proposal_refresh(spark, sf_dir):
    return S.refreshed(proposals(spark, sf_dir), NOW, 5 * DAY, F.lit(0), F.col("proposal_id") % 3).select("proposal_id", "fresh_status")


@query(PROPOSALS, "SELECT author, count(*) AS backlog FROM proposals WHERE status IN ('submitted', 'approved') GROUP BY author")
def proposal_backlog(spark, sf_dir):
    return proposals(spark, sf_dir).where(F.col("status").isin("submitted", "approved")).groupBy("author").agg(F.count("*").alias("backlog"))


@query(PROPOSALS, f"SELECT (moment // {DAY})::BIGINT AS day, count(*) AS n FROM proposals GROUP BY 1")
def daily_proposals(spark, sf_dir):
    return proposals(spark, sf_dir).groupBy(F.floor(F.col("moment") / DAY).alias("day")).agg(F.count("*").alias("n"))


@query(PROPOSALS, "SELECT proposal_id, moment, status FROM proposals WHERE author = 5 AND status = 'draft'")
def proposal_list(spark, sf_dir):
    return proposals(spark, sf_dir).where("author = 5 and status = 'draft'").select("proposal_id", "moment", "status")


HALVES = """known AS (SELECT 'u' || user_id || ':' || k AS key, ['open', 'resolved', 'ignored', 'acknowledged'][max(event_id) % 4 + 1] AS status, arg_max(event_type, event_id) AS hash FROM ev WHERE event_id % 2 = 0 GROUP BY 1),
found AS (SELECT 'u' || user_id || ':' || k AS key, arg_max(event_type, event_id) AS hash FROM ev WHERE event_id % 2 = 1 GROUP BY 1),
merged AS (SELECT coalesce(k.key, f.key) AS key, CASE WHEN k.key IS NULL OR (f.key IS NOT NULL AND k.status IN ('resolved', 'ignored') AND k.hash <> f.hash) THEN 'open' WHEN f.key IS NULL AND k.status IN ('open', 'acknowledged', 'proposed') THEN 'resolved' ELSE k.status END AS status, coalesce(f.hash, k.hash) AS hash FROM known k FULL JOIN found f ON k.key = f.key)"""


def merged(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("key", F.concat(F.lit("u"), "user_id", F.lit(":"), "k"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("open", "resolved", "ignored", "acknowledged")]), (F.max("event_id") % 4 + 1).cast("int"))
    last = F.max_by("event_type", "event_id").alias("hash")
    known = e.where("event_id % 2 = 0").groupBy("key").agg(state.alias("status"), last)
    return S.merge_signals(known, e.where("event_id % 2 = 1").groupBy("key").agg(last))


@query(EVENTS, HALVES, "SELECT key, status, hash FROM merged")
def signals_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@query(EVENTS, HALVES, "SELECT key, status FROM merged WHERE status IN ('open', 'acknowledged')")
def signals_actionable(spark, sf_dir):
    return merged(spark, sf_dir).where(F.col("status").isin("open", "acknowledged")).select("key", "status")


@query(EVENTS, "SELECT event_type AS job, (moment // 21600)::BIGINT AS window_key, arg_min(event_id, moment * 10000000 + event_id) AS claimed_by, count(*) AS claims FROM ev GROUP BY 1, 2")
def scheduler_windows(spark, sf_dir):
    return S.windows(events(spark, sf_dir).select(F.col("event_type").alias("job"), "moment", F.col("event_id").alias("id")), 21600)


@query(EVENTS, f"SELECT max(moment) AS last, {NOW} - max(moment) < 900 AS active FROM ev")
def quiet_period(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("moment").alias("last"), (F.lit(NOW) - F.max("moment") < 900).alias("active"))


@query(EVENTS, "SELECT event_id, moment FROM ev ORDER BY moment DESC, event_id DESC LIMIT 500")
def lru_prune(spark, sf_dir):
    return newest(events(spark, sf_dir).select("event_id", "moment"), 500, [F.desc("moment"), F.desc("event_id")])


@query(EVENTS, "SELECT user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, event_id DESC) <= 10")
def hot_keep_n(spark, sf_dir):
    return newest(events(spark, sf_dir).select("user_id", "event_id", "moment"), 10, [F.desc("moment"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query(EVENTS, f"SELECT event_id FROM ev WHERE moment + (value * 3600)::BIGINT > {NOW - 6 * DAY}")
def cache_ttl(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ttl", F.round(F.col("value") * 3600).cast("long"))
    return S.fresh(e, NOW - 6 * DAY).select("event_id")


@query(EVENTS, "used AS (SELECT user_id, list(DISTINCT k) AS ks FROM ev GROUP BY user_id)", "SELECT user_id FROM used WHERE NOT list_has_any(ks, [3, 5]::BIGINT[])")
def hot_invalidate(spark, sf_dir):
    used = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("k").alias("ks"))
    return used.where(~F.arrays_overlap("ks", F.array(F.lit(3).cast("long"), F.lit(5).cast("long")))).select("user_id")


@query(EVENTS, "SELECT user_id, max(gap)::BIGINT AS longest, count(*) FILTER (gap >= 7200) AS gaps FROM (SELECT user_id, moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS gap FROM ev) GROUP BY user_id")
def idle_gaps(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.col("moment") - F.lag("moment").over(Window.partitionBy("user_id").orderBy("moment", "event_id"))
    return events(spark, sf_dir).withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("longest"), F.count_if(F.col("gap") >= 7200).alias("gaps"))


@query(CONCEPTS, VECTORS, "SELECT c.id, path, CASE WHEN v.status = 'stale' THEN 0 ELSE 1 END::INT AS state FROM concepts c LEFT JOIN vectors v ON c.id = v.id WHERE v.id IS NULL OR v.status IN ('stale', 'missing')")
def embedding_pending(spark, sf_dir):
    return S.pending(concepts(spark, sf_dir), vectors(spark, sf_dir))


@query(CONCEPTS, VECTORS, "SELECT v.id, CASE WHEN c.id IS NOT NULL AND c.doc_id % 9 <> 0 THEN v.status ELSE 'stale' END AS status FROM vectors v LEFT JOIN concepts c ON c.id = v.id")
def embedding_staleness(spark, sf_dir):
    c = concepts(spark, sf_dir)
    had = vectors(spark, sf_dir).join(c.select("id", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("content_hash")).alias("hash")), "id", "left")
    return S.staleness(had.select("id", "status", F.coalesce("hash", F.lit("none")).alias("hash")), c.select("id", F.col("content_hash").alias("now_hash")))


@query(CONCEPTS, VECTORS, "SELECT count(*) AS concepts, count(*) FILTER (v.status = 'ready') AS ready, count(*) = count(*) FILTER (v.status = 'ready') AS complete FROM concepts c LEFT JOIN vectors v ON c.id = v.id")
def readiness(spark, sf_dir):
    rows = concepts(spark, sf_dir).join(vectors(spark, sf_dir).select("id", F.col("status").alias("s")), "id", "left")
    out = rows.agg(F.count("*").alias("concepts"), F.count_if(F.col("s") == "ready").alias("ready"))
    return out.withColumn("complete", F.col("concepts") == F.col("ready"))


@query(EVENTS, "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY event_type")
def latency_report(spark, sf_dir):
    e = events(spark, sf_dir)
    found = quantiles(e, "value", [0.5, 0.95, 0.99], "event_type")
    cols = [F.round(F.max(F.when(F.col("fraction") == p, F.col("x"))), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return found.groupBy(F.col("g").alias("event_type")).agg(*cols).join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")


@query(EVENTS, "SELECT user_id, count(*) FILTER (event_type = 'error') > 0 AND (SELECT count(DISTINCT user_id) FROM ev WHERE event_type = 'error') > 1 AS may_leave FROM ev GROUP BY user_id")
def last_admin_guard(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") > 0).alias("admin"))
    admins = e.agg(F.count_if("admin").alias("admins"))  # one row
    return e.crossJoin(F.broadcast(admins)).select("user_id", (F.col("admin") & (F.col("admins") > 1)).alias("may_leave"))
