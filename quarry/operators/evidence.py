"""Evidence for answers: eligibility, supersession and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import SENSITIVE_TAGS, STALE_STATES, STALE_TAGS


def has_tag(tags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(x) for x in names]))


def eligible(concepts: DataFrame, temporal: str = "neutral", space: str = "") -> DataFrame:
    """Concepts that may be evidence: not sensitive, in the asked namespace, and for current questions neither old nor disputed."""
    keep = ~has_tag(F.col("tags"), SENSITIVE_TAGS)
    if space:
        keep = keep & F.col("path").startswith(f"/{space}/")
    if temporal == "current":
        keep = keep & ~(F.col("status").isin(STALE_STATES) | has_tag(F.col("tags"), STALE_TAGS))
    return concepts.where(keep)


def unsuperseded(concepts: DataFrame) -> DataFrame:
    """Concepts that no other of them supersedes."""
    gone = concepts.select(F.explode("supersedes").alias("id")).distinct()
    return concepts.join(gone, "id", "left_anti")


def excerpts(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked (rank, text) with excerpt: texts in order of rank until `budget` characters are used; the last is cut.

    ranked is one question's bounded list.
    """
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return ranked.withColumn("excerpt", F.substring("text", F.lit(1), left.cast("int"))).where(F.length("excerpt") > 0)


def text_matches(terms: list[str], words: Column) -> Column:
    """Whether words hold one of a single term, or two of several; terms of five letters and more match by their first five."""

    def found(t: str):
        return lambda w: F.startswith(w, F.lit(t[:5])) if len(t) >= 5 else w == t

    hits = [F.exists(words, found(t)).cast("int") for t in terms]
    return sum(hits, F.lit(0)) >= min(2, len(terms))
