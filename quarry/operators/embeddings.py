"""Stored vectors of concepts kept up to date: what is fresh stays, the rest is embedded in batches, failures are rows.

A stored row is (id, path, text_hash, model_id, dimensions, model_revision, revision, status, vector, norm, error), one for each concept.
The model is a function from a list of texts to a list of vectors that runs in the tasks; texts never pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STORED = "id string, path string, text_hash string, model_id string, dimensions int, model_revision string, revision string, status string, vector array<double>, norm double, error string"
#: Characters of an error that are kept.
ERROR_CHARS = 1000


@dataclass(frozen=True)
class Model:
    """What tells one model from another, and how it embeds a list of texts."""

    model_id: str
    dimensions: int
    revision: str
    embed: Callable[[list[str]], list[list[float]]]

    def __post_init__(self) -> None:
        if not self.model_id.strip() or self.dimensions < 1:
            raise ValueError("a model needs a name and one dimension at least")

    def same(self) -> Column:
        return F.col("model_id").eqNullSafe(F.lit(self.model_id)) & F.col("dimensions").eqNullSafe(F.lit(self.dimensions)) & F.col("model_revision").eqNullSafe(F.lit(self.revision))


def model_stale(stored: DataFrame, model: Model) -> DataFrame:
    """stored as the model sees it: rows of another model, size or revision are stale and bear the model's names."""
    own = {"status": F.when(model.same(), F.col("status")).otherwise("stale"), "model_id": F.lit(model.model_id), "dimensions": F.lit(model.dimensions), "model_revision": F.lit(model.revision)}
    return stored.select(*[own.get(c, F.col(c)).alias(c) for c in stored.columns])


def checked(vector: list[float] | None, dimensions: int) -> tuple[list[float] | None, float | None, str | None]:
    """(vector, norm, error): finite numbers, as many as the model has dimensions, not all of them zero."""
    if vector is None or len(vector) != dimensions:
        return None, None, f"{0 if vector is None else len(vector)} dimensions where the model has {dimensions}"
    if not all(math.isfinite(x) for x in vector):
        return None, None, "a component that isn't finite"
    norm = math.sqrt(math.fsum(x * x for x in vector))
    if not norm or not math.isfinite(norm):
        return None, None, "a vector without a length"
    return [float(x) for x in vector], norm, None


def embedded(texts: list[str], model: Model) -> list[tuple[list[float] | None, float | None, str | None]]:
    """checked() vectors of a batch; where the batch fails, of each text by itself, so that one bad text costs no other."""
    try:
        vectors = model.embed(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [checked(v, model.dimensions) for v in vectors]
    except Exception as e:  # what a model raises is its own; it becomes the row's error
        if len(texts) == 1:
            return [(None, None, str(e)[:ERROR_CHARS])]
    return [embedded([text], model)[0] for text in texts]


def refresh(concepts: DataFrame, stored: DataFrame, model: Model, revision: str, batch: int = 32, only: DataFrame | None = None) -> DataFrame:
    """The stored rows of a revision: one for each concept that has one or gets one.

    concepts: id, path, text (null: empty), ids being unique; stored: as in the module's notes, one row an id at most. A ready row of the same
    text and model stays and takes the concept's path. All others are embedded anew, `batch` texts at a time: status ready with vector and norm, or
    degraded with an error of 1,000 characters at most and no vector. Rows of concepts that are no more go. `only`, a table of paths, bounds the
    work to concepts at these paths: the others' rows stay, stale where text or model differ, and concepts without a row get none.
    Texts go to tasks by id, and no more than a batch is held beside what Arrow brings.
    """
    names = [c.split()[0] for c in STORED.split(", ")]
    text = F.coalesce("text", F.lit(""))
    now = concepts.select(F.col("id").alias("_id"), F.col("path").alias("_path"), text.alias("_text"), F.sha2(text, 256).alias("_hash"))
    if only is not None:
        named = only.select(F.col("path").alias("_path")).distinct().withColumn("_named", F.lit(True))
        now = now.join(named, "_path", "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
    else:
        now = now.withColumn("_named", F.lit(True))
    both = now.join(model_stale(stored.select(*names), model), F.col("_id") == F.col("id"), "left")
    fresh = F.coalesce((F.col("status") == "ready") & (F.col("text_hash") == F.col("_hash")), F.lit(False))
    # a stored row that isn't refreshed keeps its status, but isn't ready if its text has changed
    status = F.when(fresh | (F.col("status") != "ready"), F.col("status")).otherwise("stale")
    kept = both.where(fresh | (~F.col("_named") & F.col("id").isNotNull()))
    own = {"path": F.col("_path"), "status": status, "revision": F.when(status == "ready", F.lit(revision)).otherwise(F.col("revision"))}
    kept = kept.select(*[own.get(c, F.col(c)).alias(c) for c in names])

    def embedding(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = embedded(part["_text"].tolist(), model)
                out = pd.DataFrame({"id": part["_id"].tolist(), "path": part["_path"].tolist(), "text_hash": part["_hash"].tolist()})
                out["model_id"], out["dimensions"], out["model_revision"], out["revision"] = model.model_id, model.dimensions, model.revision, revision
                out["status"] = ["degraded" if v is None else "ready" for v, _, _ in rows]
                out["vector"], out["norm"], out["error"] = [v for v, _, _ in rows], [n for _, n, _ in rows], [e for _, _, e in rows]
                yield out[names]

    todo = both.where(F.col("_named") & ~fresh).select("_id", "_path", "_text", "_hash")
    return kept.unionByName(todo.mapInPandas(embedding, STORED))


def embedding_state(concepts: DataFrame, stored: DataFrame, revision: str) -> DataFrame:
    """(concepts, ready, state), one row: state is the revision if all concepts have a ready vector, else "partial", or "" if none has."""
    rows = concepts.select("id").join(stored.select("id", "status"), "id", "left")
    out = rows.agg(F.count("*").alias("concepts"), F.count_if(F.col("status") == "ready").alias("ready"))
    return out.withColumn("state", F.when(F.col("ready") == F.col("concepts"), F.lit(revision)).when(F.col("ready") > 0, "partial").otherwise(""))
