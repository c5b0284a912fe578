"""Evidence for many questions at once: adaptive ranks, then what the best concepts link to.

All questions go together: candidates, anchors and neighbours are rows of (qid, ...), and each question's lists are ranked by windows of
which no more than the bounded number goes on. Inputs:

- questions: qid, text; what a question asks for is functions.text.question_profile().
- ranked: qid, rank, id - candidates of a search in order, such as index.search_many() has them.
- concepts: id, path, title, body, status, tags, supersedes (list of ids). links: source_id, target_id.

Null texts ask for nothing; questions without candidates have no rows. Ids and qids are keys. Repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import SENSITIVE_TAGS, STALE_STATES, STALE_TAGS, question_profile
from quarry.operators.evidence import has_tag
from quarry.operators.tables import cut

# Tags of what was once so; how many candidates are looked at first, and at most; anchors, and places kept for what they link to.
PAST_TAGS = ["historical", "temporal"]
FIRST, MOST, ANCHORS, RESERVE = 5, 10, 2, 2
#: Letters by which terms match words.
STEM = 5


def profiled(questions: DataFrame) -> DataFrame:
    """(qid, secret, temporal, relational, space, terms) of questions (qid, text); terms is a list."""
    p = questions.select("qid", question_profile(F.col("text")).alias("p"))
    terms = F.filter(F.split("p.terms", " "), lambda t: t != "")
    return p.select("qid", "p.secret", "p.temporal", "p.relational", F.col("p.namespace").alias("space"), terms.alias("terms"))


def may_be_evidence() -> Column:
    """Of rows with a profile and a concept: not sensitive, in the asked namespace, and for current questions neither old nor disputed."""
    stale = F.col("status").isin(STALE_STATES) | has_tag(F.col("tags"), STALE_TAGS)
    inside = (F.col("space") == "") | F.col("path").startswith(F.concat(F.lit("/"), F.col("space"), F.lit("/")))
    return ~F.coalesce(has_tag(F.col("tags"), SENSITIVE_TAGS), F.lit(False)) & inside & ((F.col("temporal") != "current") | ~F.coalesce(stale, F.lit(False)))


def stems(words: Column) -> Column:
    """The first five letters of each word, which are the whole of a shorter one, each once."""
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def matches(terms: Column, own: Column) -> Column:
    """Whether words, of which `own` are the stems(), hold one of a single term, or two of several; terms of five letters and more match by their first five. No terms match nothing."""
    # hits are looked up, since terms times words is most of the work
    asked = F.transform(terms, lambda t: F.substring(t, 1, STEM))
    held = F.array_intersect(asked, own)
    hits = F.when(F.size(held) < 2, F.size(F.filter(asked, lambda t: F.array_contains(held, t)))).otherwise(2)
    return (F.size(terms) > 0) & (hits >= F.least(F.lit(2), F.size(terms)))


def eligible(profiles: DataFrame, ranked: DataFrame, concepts: DataFrame) -> DataFrame:
    """(qid, rank, id, path, ...): candidates that may be evidence, and what each says for sufficiency.

    A concept's words are taken from its text once, and not for each question that it's a candidate of.
    """
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "body")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    ranked = cut(ranked.select("qid", "rank", "id"), "ranked")
    own = concepts.join(ranked.select("id").distinct(), "id", "left_semi").select("id", "path", "status", "tags", "supersedes", stems(words).alias("stems"))
    rows = ranked.join(profiles, "qid").join(own, "id").where(may_be_evidence())
    past = (F.col("status") == "deprecated") | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in PAST_TAGS]))
    false = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("qid", "rank", "id", "path", "temporal", "supersedes", matches(F.col("terms"), F.col("stems")).alias("match"), false(past).alias("past"), false(F.col("status") == "active").alias("current"))


def newest(rows: DataFrame) -> DataFrame:
    """Rows that no other of the question's supersedes; all, where it asks for the past."""
    gone = rows.select("qid", F.explode("supersedes").alias("id")).distinct().withColumn("gone", F.lit(True))
    return rows.join(gone, ["qid", "id"], "left").where(F.col("gone").isNull() | (F.col("temporal") == "historical")).drop("gone")


def sufficient(rows: DataFrame) -> DataFrame:
    """(qid, sufficient) of eligible rows, all of which are where the question asks: one matches the terms, and one is of its time."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    timely = F.when(F.col("temporal") == "historical", F.col("past")).when(F.col("temporal") == "current", F.col("current")).otherwise(True)
    return rows.groupBy("qid").agg((some("match") & some(timely)).alias("sufficient"))


def adaptive(profiles: DataFrame, ranked: DataFrame, concepts: DataFrame) -> DataFrame:
    """(qid, place, id, path, escalated): eligible candidates in order, of the first FIRST if these suffice, else of MOST.

    The longer list is searched once; the shorter is its beginning.
    """
    rows = cut(eligible(profiles, ranked.where(F.col("rank") <= MOST), concepts), "candidates")
    first, every = newest(rows.where(F.col("rank") <= FIRST)), newest(rows)
    enough = cut(sufficient(first).where("sufficient"), "sufficient")
    kept = first.join(enough, "qid").withColumn("escalated", F.lit(False)).union(every.join(enough, "qid", "left_anti").withColumns({"sufficient": F.lit(False), "escalated": F.lit(True)}))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))  # of MOST rows at most
    return kept.select("qid", place.alias("place"), "id", "path", "escalated")


def traverse(questions: DataFrame, ranked: DataFrame, concepts: DataFrame, links: DataFrame, most: int = 6) -> DataFrame:
    """(qid, position, id, path, source, anchor): the evidence of each question in order, `most` concepts at most.

    First adaptive() ones; where the question is about relations two places are kept for the neighbours of the best two: targets
    of the first's links by path, then what links to it, then the second's, each concept at its first discovery. Neighbours must be eligible, and
    unless the question is about the past not superseded by one of the first. source: search or graph; anchor: the concept whose link led there.
    """
    profiles = profiled(questions)
    ordered = cut(adaptive(profiles, ranked, concepts), "ordered")
    keep = F.when(F.col("relational"), F.lit(max(1, most - min(RESERVE, max(0, most - 1))))).otherwise(F.lit(most))
    primary = ordered.join(profiles.select("qid", "relational"), "qid").where(F.col("place") <= keep)
    counts = primary.groupBy("qid").agg(F.count("*").alias("have"))
    first = primary.where("relational").where(F.col("place") <= ANCHORS).select("qid", "place", F.col("id").alias("anchor"))
    steps = links.where("target_id is not null and source_id <> target_id").select("source_id", "target_id").distinct()
    both = steps.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("id"), F.lit(0).alias("way")).union(steps.select("target_id", "source_id", F.lit(1)))
    near = first.join(both, "anchor").join(primary.select("qid", "id"), ["qid", "id"], "left_anti")
    near = near.join(concepts.select("id", "path", "status", "tags"), "id").join(profiles, "qid").where(may_be_evidence())
    gone = primary.join(concepts.select("id", F.explode("supersedes").alias("old")), "id").select("qid", F.col("old").alias("id"), F.lit(True).alias("gone")).distinct()
    near = near.join(gone, ["qid", "id"], "left").where(F.col("gone").isNull() | (F.col("temporal") == "historical"))
    found = near.groupBy("qid", "id", "path").agg(F.min(F.struct("place", "way", "path", "id", "anchor")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    found = found.withColumn("r", rank).where(F.col("r") <= most).join(counts, "qid").where(F.col("have") + F.col("r") <= most)
    graph = found.select("qid", (F.col("have") + F.col("r")).cast("int").alias("position"), "id", "path", F.lit("graph").alias("source"), F.col("at.anchor").alias("anchor"))
    return primary.select("qid", F.col("place").cast("int").alias("position"), "id", "path", F.lit("search").alias("source"), F.lit(None).cast("string").alias("anchor")).union(graph)
