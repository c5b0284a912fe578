"""Who may do what: policies of principals, and proposals' changes judged by them, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of changes.
KINDS = ["create", "patch", "rename", "attach_asset_pack"]
CHANGE = "array<struct<kind: string, path: string, new_path: string>>"


def resolved(principals: DataFrame, policies: DataFrame) -> DataFrame:
    """(principal, roles, read_prefixes, write_prefixes, refused) for each principal.

    principals: principal, held (its roles); policies: principal, roles, read_prefixes, write_prefixes. A principal without a policy, or one
    whose policy has a role that it doesn't hold, is refused and has no roles or prefixes. A null `held` holds none.
    """
    both = principals.select("principal", F.coalesce("held", F.array().cast("array<string>")).alias("held")).join(policies.select("principal", "roles", "read_prefixes", "write_prefixes"), "principal", "left")
    lacks = F.array_sort(F.array_except(F.col("roles"), F.col("held")))
    refused = F.when(F.col("roles").isNull(), F.lit("unknown principal")).when(F.size(lacks) > 0, F.concat(F.lit("missing required roles: "), F.array_join(lacks, ", ")))
    allowed = lambda c: F.when(refused.isNull(), F.col(c)).otherwise(F.array().cast("array<string>")).alias(c)
    return both.select("principal", *[allowed(c) for c in ("roles", "read_prefixes", "write_prefixes")], refused.alias("refused"))


def has_role(role: str) -> Column:
    """Roles don't imply one another."""
    return F.array_contains("roles", role)


def inside(path: Column, prefixes: Column) -> Column:
    """Whether a path lies under a prefix, which ends in a slash, or is the folder itself. False for a null path or null prefixes."""
    return F.coalesce(F.exists(prefixes, lambda p: path.startswith(p) | (path == F.rtrim(p, F.lit("/")))), F.lit(False))


def normalised(proposals: DataFrame) -> DataFrame:
    """(proposal_id, principal, position, kind, path, new_path, invalid) of proposals (proposal_id, principal, changes as JSON).

    `invalid` says why a change can't be one: a kind that isn't known, no path, a rename without a new path. JSON that can't be read, or an
    empty list, is one invalid row at position null. new_path is null but for renames.
    """
    rows = proposals.select("proposal_id", "principal", F.posexplode_outer(F.from_json("changes", CHANGE)).alias("position", "c"))
    kind = F.col("c.kind")
    known = kind.isin(KINDS)
    invalid = (
        F.when(F.col("position").isNull(), F.lit("no changes"))
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unsupported change kind: "), F.coalesce(kind, F.lit(""))))
        .when(F.coalesce(F.col("c.path"), F.lit("")) == "", F.lit("no path"))
        .when((kind == "rename") & (F.coalesce(F.col("c.new_path"), F.lit("")) == ""), F.lit("no new path"))
    )
    return rows.select("proposal_id", "principal", "position", kind.alias("kind"), F.col("c.path").alias("path"), F.when(kind == "rename", F.col("c.new_path")).alias("new_path"), invalid.alias("invalid"))


def authorised(changes: DataFrame, policies: DataFrame, role: str, actions: tuple[str, ...] = ("read", "write")) -> DataFrame:
    """(proposal_id, changes, allowed, reason): whether a principal may make all changes of a proposal.

    changes: of normalised(); policies: of resolved(). A proposal goes if its principal isn't refused, has the role, and every path of every
    change, new ones too, lies under a prefix for each action. The reason is the first change's, by position, that fails. One
    aggregation by proposal; policies join by principal, as a table of their own.
    """
    p = policies.select(F.col("principal").alias("_p"), "roles", "read_prefixes", "write_prefixes", "refused")
    rows = changes.select("proposal_id", "principal", "position", "path", "new_path", "invalid").join(p, F.col("principal") == F.col("_p"), "left")
    why = F.when(F.col("invalid").isNotNull(), F.col("invalid")).when(F.col("_p").isNull(), F.lit("unknown principal")).when(F.col("refused").isNotNull(), F.col("refused"))
    why = why.when(~has_role(role), F.lit(f"lacks role: {role}"))
    for action in actions:
        for path in ("path", "new_path"):
            why = why.when(F.col(path).isNotNull() & ~inside(F.col(path), F.col(f"{action}_prefixes")), F.concat(F.lit(f"cannot {action} "), F.col(path)))
    rows = rows.withColumn("_why", why)
    first = F.min_by(F.when(F.col("_why").isNotNull(), F.col("_why")), F.when(F.col("_why").isNotNull(), F.coalesce("position", F.lit(-1))))
    return rows.groupBy("proposal_id").agg(F.count("position").alias("changes"), first.alias("reason")).select("proposal_id", "changes", F.col("reason").isNull().alias("allowed"), "reason")


def recovered(operations: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, recovery) of operations (id, repository, base, worktree) that a crash left behind, by the heads (repository, head).

    published: the operation's own revision is the head; conflict: it began from another one; else it can be tried again, as where there is no
    head yet or no base is known.
    """
    rows = operations.select("id", "repository", "base", "worktree").join(heads.select("repository", "head"), "repository", "left")
    moved = F.col("base").isNotNull() & ~F.col("base").eqNullSafe(F.col("head"))
    return rows.select("id", F.when(F.col("worktree") == F.col("head"), "published").when(moved, "conflict").otherwise("retryable").alias("recovery"))


def pruned_versions(versions: DataFrame, keep: int, wanted: DataFrame) -> DataFrame:
    """(asset, version, wanted, kept) of versions (asset, version, rank from 1, the newest): the newest `keep` stay, and all that open proposals want (asset, version)."""
    w = wanted.select("asset", "version").distinct().withColumn("_w", F.lit(True))
    rows = versions.select("asset", "version", "rank").join(w, ["asset", "version"], "left")
    wanted_ = F.coalesce("_w", F.lit(False))
    return rows.select("asset", "version", wanted_.alias("wanted"), ((F.col("rank") <= keep) | wanted_).alias("kept"))
