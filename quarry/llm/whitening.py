"""Whitening of vectors by TSQR: no covariance is formed.

1. Sums over the different vectors are exact: components are whole numbers (see scaled()), added as decimals.
2. Rows are centred with them: y = x - m for the whole number m next to the mean, and y - s / n, where s is what the sum of
   y comes to. n * x - sum(x) = n * y - s without rounding.
3. Each partition makes one triangle R of its rows, block by block (QR of the triangle so far above the next block), so a task holds
   one block. Triangles merge FAN at a time, again by QR, until one is left for each length of vectors.
4. The singular values of the last R are those of all centred rows, and its right vectors the components: e = value^2 / n.
   A row's projections on them over sqrt(e) are white.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut

#: Rows of a block, and triangles that merge at a time.
BLOCK, FAN = 2048, 8
#: Bytes of all models that go to the tasks, at most.
MOST = 256 << 20
#: Entries of more than this, scaled, count as not finite: they fit no long.
LARGE = float(1 << 61)


def scaled(v: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry c, as longs; null for vectors that are null or hold an entry that is null, not finite or too large."""
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGE))
    return F.when(ok, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset))


@dataclass
class Model:
    """Of all vectors of one length: their number, next whole means m, what sums are off n * m, unit components as columns, eigenvalues, and how much each explains."""

    n: int
    mean: np.ndarray
    off: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(np.float64) - np.array([s / self.n for s in self.off])

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum)^2, exact; null where no long holds it."""
        y = x - self.mean
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if most * most * max(1, y.shape[1]) < 1 << 62 else object
        d = y.astype(kind) * self.n - np.array(self.off, kind)
        return [z if z < 1 << 63 else None for z in (d * d).sum(axis=1).tolist()]


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their x) of each length of vectors in a batch, BLOCK rows at a time."""
    lengths = np.array(batch.column("x").value_lengths())
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            yield part, np.array(batch.column("x").take(pa.array(part)).flatten(), np.int64).reshape(len(part), d)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors and their sums, by length; each partition gives one row for each place of a vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch):
                own = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(x)
                # halves, whose sums fit
                high, low = (x >> 31).sum(axis=0), (x & (1 << 31) - 1).sum(axis=0)
                own[1] = [s + (int(h) << 31) + int(q) for s, h, q in zip(own[1], high, low, strict=True)]
        rows = [(d, i, n, str(s)) for d, (n, all_) in held.items() for i, s in enumerate(all_)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["d", "i", "n", "s"])

    rows = fit.select("x").mapInArrow(add, "d int, i int, n long, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for d, _, n, s in sorted(rows.collect()):  # one row for each place of a vector
        out.setdefault(d, (n, []))[1].append(int(s))
    return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of rows, square: with rows of zeros where they are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def triangles(fit: DataFrame, centred: dict[int, Callable[[np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
    """The last R of the centred vectors, by their length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                d = x.shape[1]
                y = centred[d](x)
                held[d] = triangle(np.vstack([held[d], y]) if d in held else y)
        yield pa.record_batch({"d": pa.array(list(held), pa.int32()), "r": pa.array([r.tobytes() for r in held.values()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        r = np.zeros((0, d))
        for raw in t.column("r"):
            r = triangle(np.vstack([r, np.frombuffer(raw.as_py()).reshape(d, d)]))
        return pa.table({"d": pa.array([d], pa.int32()), "g": pa.array([t.column("g")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    first = fit.select("x").mapInArrow(part, "d int, r binary").withColumn("g", F.spark_partition_id().cast("long"))
    left = cut(first.select("d", "g", "r"), "triangles")
    while left.groupBy("d").count().where("count > 1").count():
        left = cut(left.withColumn("g", F.floor(F.col("g") / FAN)).groupBy("d", "g").applyInArrow(merge, "d int, g long, r binary"), "merged")
    return {d: np.frombuffer(bytes(r)).reshape(d, d) for d, r in left.select("d", "r").collect()}  # one for each length


def fitted(fit: DataFrame, most: int) -> dict[int, Model]:
    """A model for each length of the different vectors fit (x)."""
    found = sums(fit)
    if sum(d * (most + 4) * 8 for d in found) > MOST:
        raise ValueError(f"models of vectors of {len(found)} lengths take over {MOST} bytes")
    models = {}
    for d, (n, total) in found.items():
        mean = [round(s / n) if abs(s) < 1 << 52 else s // n for s in total]
        off = [s - n * m for s, m in zip(total, mean, strict=True)]
        models[d] = Model(n, np.array(mean, np.int64), off, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    for d, r in triangles(fit, {d: m.centred for d, m in models.items()}).items():
        own = models[d]
        _, s, v = np.linalg.svd(r)
        whole = s > s[0] * max(own.n, d) * np.finfo(float).eps if s[0] > 0 else np.zeros(d, bool)
        k = min(most, int(whole.sum()))
        v = v[:k].T
        own.components = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
        own.values = s[:k] ** 2 / own.n
        own.explained = np.where(whole, s**2, 0) / (math.fsum(s * s) if k else math.nan)
    return models


def moments(fit: DataFrame, models: dict[int, Model], means: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Sums over the fit list, by length: of the white vectors, or with means of their centred products."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                d = x.shape[1]
                z = models[d].white(x)
                own = z.sum(axis=0) if means is None else (z - means[d]).T @ (z - means[d])
                held[d] = held[d] + own if d in held else own
        rows = [(d, i, float(v)) for d, own in held.items() for i, v in enumerate(own.ravel())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["d", "i", "v"])

    rows = fit.select("x").mapInArrow(add, "d int, i int, v double").groupBy("d", "i").agg(F.sum("v").alias("v"))
    out: dict[int, list[float]] = {}
    for d, _, v in sorted(rows.collect()):  # one row for each component, or two of them
        out.setdefault(d, []).append(v)
    return {d: np.array(v) for d, v in out.items()}


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): of each row of vectors its first `most` components.

    vectors: vec_id, embedding (floats or doubles), and any other columns, which are left aside. Rows whose vector is null or holds
    entries that are null, not finite or beyond 2^61 / scale are left out; empty vectors have no components and so no rows.
    Each different vector counts once in the fit; rows that repeat are all returned, with their vec_id, null or
    not. Vectors of different lengths have fits of their own. Components have numbers from 1 by falling eigenvalue, their greatest entry
    (by size) above zero. Those of no variance explain 0.0 (null where none has any: vectors that are all equal, or one) and whitened is
    null, as it would divide by zero; identity_error is over the others of the vectors of one length, null where there are none. deviation
    is null where it exceeds a long.
    """
    rows = vectors.select("vec_id", scaled(F.col("embedding"), scale, offset).alias("x")).where("x is not null and size(x) > 0")
    fit = cut(rows.select("x").distinct(), "fit")
    models = fitted(fit, most)
    means = {d: np.zeros(0) for d in models} | {d: v / models[d].n for d, v in moments(fit, models).items()}
    for d, v in moments(fit, models, means).items():
        k = len(models[d].values)
        models[d].error = float(np.abs(v.reshape(k, k) / models[d].n - np.eye(k)).max(initial=0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch):
                own = models[x.shape[1]]
                k, all_ = len(own.values), min(most, x.shape[1])
                none = np.full((len(at), all_ - k), np.nan)
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(at, all_))),
                    "component": pa.array(np.tile(np.arange(1, all_ + 1), len(at)), pa.int32()),
                    "n": pa.array(np.full(len(at) * all_, own.n), pa.int64()),
                    "deviation": pa.array(own.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), all_))),
                    "whitened": pa.array(np.hstack([own.white(x), none]).ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(own.explained[:all_], len(at)), from_pandas=True),
                    "identity_error": pa.array(np.full(len(at) * all_, own.error), from_pandas=True),
                })

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
