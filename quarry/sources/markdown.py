"""Concepts as Markdown: links, renames, audit, indexes and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import escaped, link_anchor, link_path, reserved

LINK = r"(?<!!)\[([^\]\[]*)\]\(([^()\s]+)\)"
TARGET = r"\]\((/[^()\s#]*)(?:#[^()\s]*)?\)"
#: A stretch of code, between fences or in a line, or of text without.
STRETCH = r"(?s)```.*?(?:```|\z)|`[^`\n]*`|[^`]+|`"


def links(concepts: DataFrame, ident: str = "path") -> DataFrame:
    """(<ident>, place, text, raw_target, target_path, anchor): inline links outside code; images don't count."""
    prose = F.regexp_replace(F.regexp_replace("body", r"(?s)```.*?(```|\z)", ""), r"`[^`\n]*`", "")
    both = F.arrays_zip(F.regexp_extract_all(prose, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(prose, F.lit(LINK), F.lit(2)).alias("href"))
    rows = concepts.select(ident, F.posexplode(both).alias("place", "l"))
    href = F.col("l.href")
    return rows.select(ident, "place", F.col("l.text").alias("text"), href.alias("raw_target"), F.when(href.startswith("/"), link_path(href)).alias("target_path"), link_anchor(href).alias("anchor"))


def rewritten(body: Column, moves: Column) -> Column:
    """body with the targets of its links and images that `moves`, a map, names replaced, all at once; anchors and code stay."""

    def hrefs(text: Column) -> Column:
        pieces = F.split(text, r"(?<=\]\()")
        target = lambda x: F.regexp_extract(x, r"\A(/[^()\s#]*)(?=(?:#[^()\s]*)?\))", 1)
        moved = lambda x, i: F.when(i > 0, F.concat(F.try_element_at(moves, target(x)), F.substring(x, F.length(target(x)) + 1, F.length(x))))
        return F.array_join(F.transform(pieces, lambda x, i: F.coalesce(moved(x, i), x)), "")

    stretches = F.regexp_extract_all(body, F.lit(STRETCH), F.lit(0))
    return F.array_join(F.transform(stretches, lambda x: F.when(x.startswith("`") | ~x.contains("]("), x).otherwise(hrefs(x))), "")


def judged_renames(concepts: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (old, new), each different one once, with issue: null, or why it can't be: bad_path (null, reserved, or the same), not_found, taken
    (a concept has the new path, even one that moves away) or ambiguous (one old path has several new ones, or one new path several old)."""
    rows = renames.select("old", "new").distinct()
    for x, y in (("old", "new"), ("new", "old")):
        rows = rows.join(rows.groupBy(F.col(x).alias("_k")).agg(F.count("*").alias("_n_" + x)), F.col(x).eqNullSafe(F.col("_k")), "left").drop("_k")
    paths = concepts.select(F.col("path").alias("_p")).distinct()
    for x in ("old", "new"):
        rows = rows.join(paths.select(F.col("_p").alias(x), F.lit(True).alias("_is_" + x)), x, "left")
    bad = F.col("old").isNull() | F.col("new").isNull() | (F.col("old") == F.col("new")) | reserved(F.col("old")) | reserved(F.col("new"))
    issue = F.when(bad, "bad_path").when(F.col("_is_old").isNull(), "not_found").when(F.col("_is_new").isNotNull(), "taken").when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), "ambiguous")
    return rows.select("old", "new", issue.alias("issue"))


def rename_all(concepts: DataFrame, renames: DataFrame, stamp: dict[str, Column]) -> DataFrame:
    """concepts after all renames (old, new) that judged_renames() lets pass: paths moved, links to them rewritten wherever they stand, and the
    columns of `stamp` set in every row that either changes.

    Only the targets that a text has are joined with the renames, and its text is read once whatever their number. Rows without path or body
    stay; rows that repeat do too.
    """
    moves = judged_renames(concepts, renames).where("issue is null").select("old", "new")
    targets = concepts.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(TARGET), F.lit(1)))).alias("old")).distinct()
    maps = targets.join(moves, "old").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_moves"))
    rows = concepts.join(maps, "path", "left").join(moves.select(F.col("old").alias("path"), F.col("new").alias("_new")), "path", "left")
    body = F.when(F.col("_moves").isNotNull(), rewritten(F.col("body"), F.col("_moves")))
    rows = rows.withColumn("_body", F.coalesce(body, "body"))
    changed = F.col("_new").isNotNull() | ~F.col("_body").eqNullSafe(F.col("body"))
    out = {"path": F.coalesce("_new", "path"), "body": F.col("_body")} | {k: F.when(changed, v).otherwise(F.col(k)) for k, v in stamp.items()}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in concepts.columns])


def audit(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """(path, issue, detail): ids used twice (all but the first by path), and absolute links (path, target_path) to no concept."""
    first = concepts.groupBy("id").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = concepts.join(first, "id").where("path <> first").select("path", F.lit("duplicate_id").alias("issue"), F.col("id").alias("detail"))
    absolute = found.where(F.col("target_path").startswith("/") & ~reserved(F.col("target_path")))
    broken = absolute.join(concepts.select(F.col("path").alias("target_path")), "target_path", "left_anti").select("path", F.lit("broken_link"), "target_path")
    return twice.union(broken.distinct())


def directory_index(concepts: DataFrame) -> DataFrame:
    """(directory, n, first): for every folder above a concept, the number of its children and the first by name."""
    parts = F.split("path", "/")
    rows = concepts.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    rows = rows.select(F.concat(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/"), F.lit("/")).alias("directory"), F.element_at("p", F.col("k") + 1).alias("child")).distinct()
    return rows.groupBy("directory").agg(F.count("*").alias("n"), F.min("child").alias("first"))


def log_lines(concepts: DataFrame) -> DataFrame:
    """(updated_s, path, line) of each concept, for a log in descending order."""
    return concepts.select("updated_s", "path", F.concat(F.lit("- ["), escaped(F.coalesce("title", F.lit(""))), F.lit("]("), "path", F.lit(")")).alias("line"))
