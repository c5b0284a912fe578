"""Lifecycle state: idempotent operations, proposals, signals, caches and scheduler windows, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.nested import json_hash

# States of proposals that are still open, and of operations that a crash left behind.
PENDING = ["draft", "submitted", "approved"]
INTERRUPTED = ["queued", "running", "recovering"]


def idempotent(requests: DataFrame) -> DataFrame:
    """(principal, key, first_id, requests, conflicts) of requests (id, principal, key, hash).

    The first request of a key counts; a later one of equal hash is a replay, of another hash a conflict.
    """
    first = F.min_by("hash", "id")
    sums = requests.groupBy("principal", "key", "hash").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return sums.groupBy("principal", "key").agg(F.min("id").alias("first_id"), F.sum("n").alias("requests"), (F.sum("n") - F.min_by("n", "id")).alias("conflicts"), first.alias("first_hash"))


def refreshed(proposals: DataFrame, now: int, ttl: int, head: Column, base: Column) -> DataFrame:
    """proposals with fresh_status: expired past its time unless applied, stale if open on another base."""
    expired = (F.col("moment") + ttl < now) & (F.col("status") != "applied")
    stale = F.col("status").isin("submitted", "approved") & (base != head)
    return proposals.withColumn("fresh_status", F.when(expired, "expired").when(stale, "stale").otherwise(F.col("status")))


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """(path, total, pending), each proposal once for a path."""
    return proposals.select("proposal_id", "path", "status").distinct().groupBy("path").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(PENDING)).alias("pending"))


def merge_signals(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (key, status, hash) after a scan that found (key, hash).

    New keys open; resolved and ignored ones open again only with other evidence; open ones that weren't found resolve.
    """
    k = known.select("key", F.col("status").alias("was"), F.col("hash").alias("old"))
    f = found.select("key", F.col("hash").alias("new"))
    again = F.col("was").isin("resolved", "ignored") & (F.col("old") != F.col("new"))
    status = F.when(F.col("was").isNull() | (F.col("new").isNotNull() & again), "open").when(F.col("new").isNull() & F.col("was").isin("open", "acknowledged", "proposed"), "resolved").otherwise(F.col("was"))
    return k.join(f, "key", "full_outer").select("key", status.alias("status"), F.coalesce("new", "old").alias("hash"))


def fresh(rows: DataFrame, now: int) -> DataFrame:
    """Cached rows (moment, ttl) that haven't expired."""
    return rows.where(F.col("moment") + F.col("ttl") > now)


def windows(rows: DataFrame, seconds: int) -> DataFrame:
    """(job, window_key, claimed_by, claims): the first claim of each job and tumbling window wins."""
    rows = rows.withColumn("window_key", F.floor(F.col("moment") / seconds))
    return rows.groupBy("job", "window_key").agg(F.min_by("id", F.struct("moment", "id")).alias("claimed_by"), F.count("*").alias("claims"))


def staleness(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    """vectors (id, status, hash) against the concepts' hashes (id, now_hash): ready stays so only with an equal hash."""
    joined = vectors.join(hashes, "id", "left")
    return joined.select("id", F.when(F.col("hash").eqNullSafe(F.col("now_hash")), F.col("status")).otherwise("stale").alias("status"))


def pending(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, path, state): concepts without a vector or with a stale one; stale sort first."""
    v = vectors.select("id", F.col("status").alias("s"))
    rows = concepts.join(v, "id", "left").where("s is null or s in ('stale', 'missing')")
    return rows.select("id", "path", F.when(F.col("s") == "stale", 0).otherwise(1).alias("state"))


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two revisions (path, content_hash): added, removed or changed."""
    a, b = before.select("path", F.col("content_hash").alias("x")), after.select("path", F.col("content_hash").alias("y"))
    both = a.join(b, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def upsert(base: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """base without the changed and gone keys, and the changed rows: one incremental step of an index."""
    out = changed.select(key).union(gone.select(key))
    return base.join(out, key, "left_anti").unionByName(changed)


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the patch's values where these aren't null."""
    p = patch.select(key, *[F.col(c).alias("_" + c) for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce("_" + c, c).alias(c) if c in columns else F.col(c) for c in base.columns])


def recent_activity(concepts: DataFrame, changes: DataFrame, since: str, now: str) -> DataFrame:
    """(signal_type, id, path, severity, dedupe_key, evidence_hash): a signal for each concept that changes (path, change) name between two revisions.

    Paths that no concept has any more give none, nor does a null path; the hash is of the evidence with its keys in order.
    """
    paths = changes.select("path").distinct()
    evidence = F.to_json(F.struct("path", F.lit(since).alias("since_revision"), F.lit(now).alias("repo_revision")))
    key = F.concat_ws("|", F.lit("recent_activity"), "id", F.lit(now))
    rows = concepts.join(paths, "path", "left_semi")
    return rows.select(F.lit("recent_activity").alias("signal_type"), "id", "path", F.lit("low").alias("severity"), key.alias("dedupe_key"), json_hash(evidence).alias("evidence_hash"))
