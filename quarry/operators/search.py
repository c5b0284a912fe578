"""Search over concepts: scoped BM25, vector and hybrid ranking.

bm25() scores a table of concepts as it stands, in one pass for statistics and one for scores. operators.index keeps the postings of a
corpus that many searches read, and gives the same scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ACCENTED, PLAIN, tokens
from quarry.operators.tables import partitions

# Weights of the fields, BM25's constants, and those of rank fusion.
WEIGHTS = {"title": 5.0, "description": 5.0, "aliases": 4.0, "tags": 1.0, "body": 5.0, "path": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF, LEXICAL, SEMANTIC = 60, 0.5, 1.0
MOST = 100
#: Vectors that meet a tile at once.
ROWS = 256


def visible(prefixes: list[str] | None, path: str = "path") -> Column:
    """Paths under one of the prefixes; all where no prefixes are given or / is one. Goes first, so that it reaches the scan."""
    if prefixes is None or "/" in prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | (F.col(path) == p.rstrip("/")) | F.col(path).startswith(p)
    return out


def filtered(concepts: DataFrame, kind: str | None = None, status: str | None = None, prefix: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """Concepts of a type, status and path prefix that have all the tags."""
    if kind:
        concepts = concepts.where(F.col("type") == kind)
    if status:
        concepts = concepts.where(F.col("status") == status)
    if prefix:
        concepts = concepts.where(F.col("path").startswith(prefix))
    for t in tags:
        concepts = concepts.where(F.array_contains("tags", t))
    return concepts


def field_texts(concepts: DataFrame) -> list[Column]:
    """The texts of WEIGHTS' fields, in order; lists are joined, and a column that isn't there is empty."""

    def text(name: str) -> Column:
        if name not in concepts.columns:
            return F.lit("")
        return F.array_join(name, " ") if concepts.schema[name].dataType.typeName() == "array" else F.col(name)

    return [text(f) for f in WEIGHTS]


def fields(concepts: DataFrame) -> DataFrame:
    """concepts with _<field>, the tokens of each field of WEIGHTS; see field_texts()."""
    return concepts.withColumns({"_" + f: tokens(t) for f, t in zip(WEIGHTS, field_texts(concepts), strict=True)})


def plain_terms(text: str) -> list[str]:
    """The terms of a plain query, in order, repeats kept: as tokens(), of one string. No term at all is an error."""
    found = re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(ACCENTED, PLAIN)))
    if not found:
        raise ValueError("a query needs a letter or digit")
    return found


def postings(concepts: DataFrame) -> DataFrame:
    """(term, id, field, tf): the inverted index."""
    rows = fields(concepts).select("id", F.explode(F.create_map(*[x for f in WEIGHTS for x in (F.lit(f), F.col("_" + f))])).alias("field", "ts"))
    return rows.select("id", "field", F.explode("ts").alias("term")).groupBy("term", "id", "field").agg(F.count("*").alias("tf"))


def counts(concepts: DataFrame, terms: list[str]) -> DataFrame:
    """concepts with _len and, for each term, _w<i>, its weighted count over the fields."""
    rows = fields(concepts)
    times = lambda f, t: F.size(F.filter(F.col("_" + f), lambda x: x == t)).cast("double") * WEIGHTS[f]
    if not terms:
        raise ValueError("a query needs a term")
    cols = {f"_w{i}": sum((times(f, t) for f in WEIGHTS), F.lit(0.0)) for i, t in enumerate(terms)}
    size = sum((F.size("_" + f) for f in WEIGHTS), F.lit(0)).cast("double")
    return rows.withColumns(cols | {"_len": size}).drop(*["_" + f for f in WEIGHTS])


def bm25(concepts: DataFrame, terms: list[str], every: bool = False, prefixes: list[str] | None = None, scoped_stats: bool = False) -> DataFrame:
    """Visible concepts that hold any (or every) term, with score (greater is better).

    Statistics are over all concepts, or with scoped_stats over the visible ones; they come from one aggregation
    to one row, which joins back as such. A term given twice counts twice. Null texts are empty.
    """
    rows = counts(concepts, terms)
    seen = rows.where(visible(prefixes)) if scoped_stats else rows
    stats = seen.agg(F.count("*").cast("double").alias("_N"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_w{i}") > 0).cast("double").alias(f"_n{i}") for i in range(len(terms))])
    rows = rows.where(visible(prefixes))
    hit = [F.col(f"_w{i}") > 0 for i in range(len(terms))]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if every else keep | h
    out = rows.where(keep).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("_N") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_w{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return out.withColumn("score", score).drop("_N", "_avg", "_len", *[f"_{x}{i}" for x in "nw" for i in range(len(terms))])


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a total order, limit clamped to 1..MOST."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST)))


def page_with_next(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, as page() has it, with place (from 1) and has_next, whether a row comes after it: one row more is looked at."""
    limit = max(1, min(limit, MOST))
    ahead = rows.orderBy(*order).offset(max(0, offset)).limit(limit + 1)
    place = ahead.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "has_next": F.count("*").over(Window.partitionBy()) > limit})
    return place.where(F.col("place") <= limit)


def search(concepts: DataFrame, text: str, vectors: DataFrame | None = None, asked: list[float] | None = None, limit: int = 20, offset: int = 0, prefixes: list[str] | None = None, lexical: DataFrame | None = None, **filters) -> DataFrame:
    """A page of a search: hybrid if vectors and the question's vector are given and some are ready, else lexical.

    filters: of filtered(). They and the prefixes hold for what comes back, not for the statistics. Columns: id, score, place,
    has_next. A lexical search is what answers where no vector is ready. lexical: (id, score) where an index has them, else the
    concepts are searched.
    """
    if lexical is None:
        lexical = bm25(concepts, plain_terms(text), prefixes=prefixes)
    if any(filters.values()):
        lexical = lexical.join(filtered(concepts, **filters).select("id"), "id", "left_semi")
    lexical = lexical.select("id", "score")
    if vectors is None or asked is None or vectors.where("status = 'ready'").isEmpty():
        return page_with_next(lexical, [F.desc("score"), F.col("id")], limit, offset)
    scope = filtered(concepts.where(visible(prefixes)), **filters).select("id")
    fused = hybrid(lexical, semantic(vectors.join(scope, "id", "left_semi"), asked)).select("id", F.col("fused").alias("score"))
    return page_with_next(fused, [F.desc("score"), F.col("id")], limit, offset)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is null, of another length, or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def valid_vector(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (dot(v, v) > 0), F.lit(False))


def semantic(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Ready vectors with their cosine to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where("status = 'ready'").withColumn("cosine", cosine(F.col("embedding"), q))


def hybrid(lexical: DataFrame, similar: DataFrame, candidates: int = 200) -> DataFrame:
    """Reciprocal rank fusion of the best `candidates` of each; only what has a ready vector comes back."""
    lex = lexical.orderBy(F.desc("score"), "id").limit(candidates).select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("lexical_rank"))
    sem = similar.orderBy(F.desc("cosine"), "id").limit(candidates).select("id", "cosine", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")).alias("semantic_rank"))
    both = sem.join(lex, "id", "left")
    return both.withColumn("fused", F.coalesce(F.lit(LEXICAL) / (F.lit(RRF) + F.col("lexical_rank")), F.lit(0.0)) + F.lit(SEMANTIC) / (F.lit(RRF) + F.col("semantic_rank")))


def neighbours(vectors: DataFrame, least: float = 0.75, k: int = 12, tile: int = 16384) -> DataFrame:
    """(a, b, cosine, rank): the k nearest ready vectors of each with cosine of at least `least`; ties by id.

    Vectors of one length are dealt to tiles, and tiles meet two by two: a product of matrices each, of which
    each vector keeps its k best, so rows that travel on are at most k for a vector and a tile. The work grows with the square
    of the vectors. Invalid vectors (null, zero, not finite) have no neighbours.
    """
    spark = vectors.sparkSession
    ready = vectors.where((F.col("status") == "ready") & valid_vector(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("vec"), F.size("embedding").alias("dims"))
    n = ready.count()
    # small tables are dealt to smaller tiles, so that all tasks have some
    tiles = max(1, -(-n // tile), min(-(-n // 1000), round(2 * partitions(spark) ** 0.5)))
    dealt = ready.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, x, y = (c.as_py() for c in key)
        t = t.sort_by("id")
        ids, v, own = t["id"].combine_chunks(), np.array(t["vec"].combine_chunks().flatten()).reshape(t.num_rows, -1), np.array(t["own"])
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        low, high = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = [best_of(v, rows, others, least, k) for rows, others in (((low, high),) if x == y else ((low, high), (high, low)))]
        a, b, cos = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "cosine": cos})

    # a number of tasks is named, else few bytes would be one task
    dealt = dealt.repartition(min(tiles * (tiles + 1) // 2, 8 * partitions(spark)), "dims", "x", "y")
    best = dealt.groupBy("dims", "x", "y").applyInArrow(meet, "a string, b string, cosine double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of(v: np.ndarray, rows: np.ndarray, others: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of each of rows of v with its k best of others, itself left out; of equal ones those that come first."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for first in range(0, len(rows), ROWS):
        some = rows[first : first + ROWS]
        cos = v[some] @ v[others].T
        near = cos >= least
        near &= others != some[:, None]
        if 0 < k < len(others):
            # the k-th best of a row; all that equal it stay until ties are settled
            full = np.flatnonzero(near.sum(axis=1) > k)
            kth = np.partition(np.where(near[full], cos[full], -np.inf), -k, axis=1)[:, -k]
            near[full] &= cos[full] >= kth[:, None]
        i, j = np.nonzero(near)
        c = cos[i, j]
        order = np.lexsort((j, -c, i))
        i, j, c = i[order], j[order], c[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        for column, values in zip(out, (some[i[kept]], others[j[kept]], c[kept]), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) for c in out)


def mutual(nearest: DataFrame) -> DataFrame:
    """(a, b, cosine, mutual): each pair once, mutual where both name each other."""
    return nearest.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("cosine").alias("cosine"), (F.count("*") == 2).alias("mutual")).select(F.col("x").alias("a"), F.col("y").alias("b"), "cosine", "mutual")
