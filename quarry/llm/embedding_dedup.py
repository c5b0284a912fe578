"""Near-duplicates among vectors by a subspace pigeonhole join.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. After a rotation that deals
out what the vectors hold, the dimensions are split into blocks; if all blocks differed by more than their
share of that budget (in proportion to their dimensions), so would the sum. So every pair shows in one block,
where it is within a small distance: a range join there, on a grid over the block's first dimensions with
cells as wide as that distance, finds all candidates. Each is verified by its cosine in double precision, in
the first block that it shows in, so that no pair counts twice.

Equal vectors are one class. Into cells go ids with a byte for each component of the block. A cell's rows are split into
tiles of bounded size; tiles meet pairwise, and only rows that have another in reach there, by a bound that the bytes' rounding
can't break, get their vectors. These give a count for each vector and a few links that join what is linked, never a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import components, cut

#: Vectors of a cell that a tile holds, about.
TILE = 1500
#: Of a component from 0 to 1 in the codes of cells.
STEPS = 127


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, blocks: int) -> list[np.ndarray]:
    return [x for x in np.array_split(np.arange(dims), min(blocks, dims)) if len(x)]


def valid(v: Column) -> Column:
    """Vectors that can be compared: components finite and not null, and not all zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), np.float64).reshape(len(flat), -1)


def cells(vectors: DataFrame, cosine: float, blocks: int, grid: int, seed: int) -> DataFrame:
    """(dims, block, cell, asks, inside, v, code): each vector once at home in each block, and asking in cells in reach.

    code has the vector's components in the block, rotated, as whole numbers of 1 / STEPS.
    """

    def place(batches):
        for batch in batches:
            dims = np.array(batch.column("dims"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = units(matrix(part.column("vec"))) @ rotation(int(d), seed)
                for k, own in enumerate(blocks_of(int(d), blocks)):
                    reach = np.sqrt((2 - 2 * cosine) * len(own) / d + 1e-9)  # what compare() takes as near
                    base = 2 * int(np.ceil(1 / reach)) + 5
                    first = own[: max(1, min(grid, int(62 / np.log2(base))))]  # as many as keep the numbers of cells apart
                    at = np.floor(x[:, first] / reach).astype(np.int64)
                    shift = x[:, first] / reach - at
                    every = np.arange(len(x))
                    # at home, asking there, and asking in the cells after it that have a point in reach; those before it ask here
                    rows, asked, asks = [every, every], [at, at], [np.zeros(len(x), bool), np.ones(len(x), bool)]
                    inside = [np.ones(len(x), bool)] * 2
                    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * at.shape[1], indexing="ij"), -1).reshape(-1, at.shape[1])
                    for step in steps[len(steps) // 2 + 1 :]:
                        gap = np.where(step < 0, shift, np.where(step > 0, 1 - shift, 0))
                        near = np.flatnonzero((gap * gap).sum(axis=1) <= 1 + 1e-9)
                        rows.append(near)
                        asked.append(at[near] + step)
                        asks.append(np.ones(len(near), bool))
                        inside.append(np.zeros(len(near), bool))
                    row, cell = np.concatenate(rows), np.concatenate(asked)
                    key = np.zeros(len(cell), np.int64)
                    for j in range(cell.shape[1]):
                        key = key * base + cell[:, j] + base // 2
                    code = np.rint(x[:, own] * STEPS).astype(np.int8)
                    codes = pa.array([c.tobytes() for c in code], pa.binary()).take(pa.array(row))
                    columns = {"dims": part.column("dims").take(pa.array(row)), "block": pa.array(np.full(len(row), k), pa.int32()), "cell": pa.array(key)}
                    flags = {"asks": pa.array(np.concatenate(asks)), "inside": pa.array(np.concatenate(inside))}
                    yield pa.record_batch(columns | flags | {"v": part.column("v").take(pa.array(row)), "code": codes})

    return vectors.mapInArrow(place, "dims int, block int, cell long, asks boolean, inside boolean, v long, code binary")


def promising(tile: pa.Table, cosine: float) -> pa.Table:
    """Rows of a tile, without codes, that have one in reach on the other side.

    A code is off by half a step at most in each component, so the distance of two by the root of their length at most.
    """
    asks = np.array(tile["asks"].cast(pa.uint8()).combine_chunks(), bool)
    v = np.array(tile["v"])
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    keep = np.zeros(len(v), bool)
    if len(a) and len(b):
        code = np.frombuffer(b"".join(tile["code"].to_pylist()), np.int8).reshape(len(v), -1)
        length, d = code.shape[1], int(tile["dims"][0].as_py())
        code = code.astype(np.float32 if length <= 256 else np.float64)  # which holds these sums exactly
        most = (STEPS * np.sqrt((2 - 2 * cosine) * length / d + 1e-9) + np.sqrt(length)) ** 2 + 1
        squares = (code * code).sum(axis=1)
        for at in range(0, len(a), 500):
            i = a[at : at + 500]
            near = squares[i][:, None] + squares[b] - 2 * code[i] @ code[b].T <= most
            near &= v[i][:, None] != v[b]
            keep[i] = near.any(axis=1)
            keep[b] |= near.any(axis=0)
    return tile.drop_columns(["code"]).filter(pa.array(keep))


def compare(tile: pa.Table, cosine: float, blocks: int, seed: int) -> pa.Table:
    """Links of a tile: for each vector (v, null, links) and (v, other, 0) for some links that join all linked."""
    asks = np.array(tile["asks"].cast(pa.uint8()).combine_chunks(), bool)
    inside = np.array(tile["inside"].cast(pa.uint8()).combine_chunks(), bool)
    v, size = np.array(tile["v"]), np.array(tile["size"])
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    out_v, out_o, out_n = [], [], []
    if len(a) and len(b):
        raw = matrix(tile["vec"])
        unit = units(raw)
        d, k = raw.shape[1], int(tile["block"][0].as_py())
        x = unit @ rotation(d, seed)
        own = blocks_of(d, blocks)
        slack = lambda i: (2 - 2 * cosine) * len(own[i]) / d + 1e-9
        near = lambda p, q, c: (p[:, c] ** 2).sum(1)[:, None] + (q[:, c] ** 2).sum(1) - 2 * p[:, c] @ q[:, c].T
        i, j = np.nonzero(near(x[a], x[b], own[k]) <= slack(k))
        i, j = a[i], b[j]
        less = ~inside[i] | (v[i] < v[j])  # in one cell, each of two asks for the other
        i, j = i[less], j[less]
        for at in range(0, len(i), 200_000):
            p, q = i[at : at + 200_000], j[at : at + 200_000]
            good = (unit[p] * unit[q]).sum(axis=1) >= cosine
            p, q = p[good], q[good]
            earlier = np.zeros(len(p), bool)
            for c in own[:k]:
                earlier |= ((x[p][:, c] - x[q][:, c]) ** 2).sum(axis=1) <= (2 - 2 * cosine) * len(c) / d + 1e-9
            p, q = p[~earlier], q[~earlier]
            sums = np.bincount(p, size[q], len(v)) + np.bincount(q, size[p], len(v))
            some = np.flatnonzero(sums)
            out_v += v[some].tolist()
            out_n += sums[some].astype(np.int64).tolist()
            out_o += [None] * len(some)
            for y, z in forest(p, q):
                out_v.append(int(v[y]))
                out_o.append(int(v[z]))
                out_n.append(0)
    return pa.table({"v": pa.array(out_v, pa.int64()), "other": pa.array(out_o, pa.int64()), "n": pa.array(out_n, pa.int64())})


def forest(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the links (p, q) join, one for each vector at most."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for y, z in zip(p.tolist(), q.tolist(), strict=True):
        r, s = root(y), root(z)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((y, z))
    return out


def linked_vectors(vectors: DataFrame, cosine: float = 0.95, blocks: int = 4, grid: int | None = None, tile: int = TILE, seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, and any other columns).

    Two rows are linked if the cosine of their vectors, in double precision, is at least `cosine`; n_links
    counts the other rows linked to a row, component_id is the least vec_id that links reach, kept says
    whether that is the row's own. Vectors that are null, empty or zero or hold null or non-finite components link with nothing, and
    so do vectors of different lengths. Components are kept as they come, float or double. Rows of one vec_id are rows of their own; a null vec_id counts as the
    greatest. grid: dimensions of a block that the range join's grid has; more for more vectors, so that a
    cell's number of vectors stays bounded.
    """
    kind = "array<double>" if "double" in vectors.schema["embedding"].dataType.simpleString() else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    rows = rows.withColumn("ok", valid(F.col("vec")))
    classes = rows.where("ok").groupBy("vec").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumns({"v": F.monotonically_increasing_id(), "dims": F.size("vec")}), "vectors")
    if grid is None:
        n = classes.count()
        grid = int(np.clip(np.ceil(np.log(max(n, 2) / 2000) / np.log(5)), 1, 6))
    placed = cut(cells(classes.select("dims", "v", "vec"), cosine, blocks, grid, seed), "cells")
    key = ["dims", "block", "cell"]
    most = placed.groupBy(key).agg(F.ceil(F.count(F.when(~F.col("asks"), 1)) / tile).alias("homes"), F.ceil(F.count(F.when(F.col("asks"), 1)) / tile).alias("visits"))
    most = most.where("homes > 0 and visits > 0")
    dealt = placed.join(most, key)
    own = F.pmod(F.xxhash64("v"), F.when(F.col("asks"), F.col("visits")).otherwise(F.col("homes")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("homes")).otherwise(F.col("visits")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumns({"x": F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), "y": F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))})
    # by the tile, else the join's partitioning would hold, with all tiles of a cell in one task
    dealt = dealt.select(*key, "x", "y", "asks", "inside", "v", "code").repartition(*key, "x", "y")
    light = "dims int, block int, cell long, x long, y long, asks boolean, inside boolean, v long"
    some = cut(dealt.groupBy(*key, "x", "y").applyInArrow(lambda t: promising(t, cosine), light), "promising")
    some = some.join(classes.select("v", "size", "vec"), "v").select(*key, "x", "y", "asks", "inside", "v", "size", "vec")
    met = cut(some.groupBy(*key, "x", "y").applyInArrow(lambda t: compare(t, cosine, blocks, seed), "v long, other long, n long"), "met")
    counts = met.groupBy("v").agg(F.sum("n").alias("n"))
    roots = components(met.where("other is not null").select(F.col("v").alias("a"), F.col("other").alias("b")))
    rooted = classes.select("v", "vec", "size", "least").join(counts, "v", "left").join(roots.select(F.col("node").alias("v"), "root"), "v", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "v")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("vec", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, (rows["vec"] == known["vec"]) & rows["ok"], "left").select(rows["vec_id"], "n_links", "component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.col("component_id").isNull()).alias("kept"))
