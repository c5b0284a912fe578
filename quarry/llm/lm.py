"""Language-model scores by stupid backoff, from n-gram counts over all documents.

Documents are dealt to chunks by hash. A chunk's distinct n-grams of all orders, as sorted 64-bit hashes with
counts, go to the buckets of a table partitioned by hash, which sums the counts of all chunks and answers
each chunk with the totals of its n-grams, in the order asked. The chunk, its texts and the answers meet by
chunk; there every n-gram of a document finds its counts, and logarithms are summed per document.

What a bucket holds follows from the number of buckets, which grows with the words. Rows that travel are
packed n-grams of one chunk for one bucket, about six bytes an n-gram.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions
from quarry.llm.words import Words, chunks, mix, whole

#: Text bytes that a chunk should hold, and n-grams that a bucket should hold.
CHUNK_TEXT = 8_000_000
BUCKET_GRAMS = 1_500_000
#: Text bytes a word, about, to tell the number of n-grams from the texts' length.
WORD_BYTES = 6


def packed(x: np.ndarray) -> bytes:
    """Numbers, like bytes together, each such plane compressed by itself: a plane of few values takes next to nothing."""
    x = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    parts = [zstandard.compress(p.tobytes(), 3) for p in x]
    return struct.pack(f"<{len(parts)}i", *map(len, parts)) + b"".join(parts)


def unpacked(raw: bytes, kind: str, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers of packed() from `at` on, and where they end."""
    size = np.dtype(kind).itemsize
    lengths = struct.unpack_from(f"<{size}i", raw, at)
    at += 4 * size
    planes = []
    for n in lengths:
        planes.append(np.frombuffer(zstandard.decompress(raw[at : at + n]), np.uint8))
        at += n
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(kind).reshape(-1), at


def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the texts, which travel by chunk."""
    for batch in batches:
        z = [None if x is None else zstandard.compress(x.encode(), 3) for x in (t.as_py() for t in batch.column("text"))]
        yield pa.record_batch({"chunk": batch.column("chunk"), "doc_id": batch.column("doc_id"), "z": pa.array(z, pa.binary())})


def texts_of(table: pa.Table) -> pa.Array:
    return pa.array([None if z is None else zstandard.decompress(z) for z in table["z"].to_pylist()], pa.binary()).cast(pa.string())


def grams(w: Words, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash of each n-gram of 1 to `order` words, and the places where these start; all in one array."""
    hashes, places = [], []
    h = w.h
    for n in range(1, order + 1):
        if n > 1:
            h = np.concatenate([mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.h[n - 1 :] + np.uint64(n)), np.zeros(1, np.uint64)])[: len(w.h) - n + 1] if len(w.h) >= n else np.zeros(0, np.uint64)
        at = whole(w, n)
        hashes.append(h[at])
        places.append(at)
    return np.concatenate(hashes), places


def ask(texts: pa.Array, chunk: int, order: int, buckets: int) -> pa.RecordBatch:
    """What a chunk asks of each bucket: (bucket, chunk, blob)."""
    found, counts = np.unique(grams(Words(texts), order)[0], return_counts=True)
    edges = np.searchsorted(found, bounds(buckets))
    rows, blobs = [], []
    for b, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(found)], strict=True)):
        if hi > lo:
            rows.append(b)
            steps = np.diff(found[lo:hi], prepend=np.uint64(0))
            blobs.append(packed(steps) + packed(counts[lo:hi].astype(np.uint32)))
    return pa.record_batch({"bucket": pa.array(rows, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def bounds(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def answer(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The totals of what each chunk asked of one bucket."""
    hashes, counts = [], []
    for _, blob in asked:
        steps, at = unpacked(blob, "<u8")
        hashes.append(np.cumsum(steps, dtype=np.uint64))
        counts.append(unpacked(blob, "<u4", at)[0])
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate(counts).astype(np.float64)).astype(np.int64)[inverse]
    ends = np.cumsum([len(h) for h in hashes])
    return [(chunk, packed(totals[e - len(h) : e])) for (chunk, _), h, e in zip(asked, hashes, ends, strict=True)]


def score(texts: pa.Array, totals: np.ndarray, words: int, order: int, least: int, backoff: float) -> np.ndarray:
    """The sum of the logarithms of stupid-backoff scores of each text's words."""
    w = Words(texts)
    h, places = grams(w, order)
    _, inverse = np.unique(h, return_inverse=True)
    counts, at = [], 0
    for n, place in enumerate(places, 1):
        c = np.zeros(w.n)
        c[place + n - 1] = totals[inverse[at : at + len(place)]]  # by the last word
        counts.append(c)
        at += len(place)
    best = np.log(np.maximum(counts[0], 1)) - math.log(max(words, 1))
    for n in range(2, order + 1):
        history = np.concatenate([np.zeros(1), counts[n - 2][:-1]])
        seen = counts[n - 1] >= least
        there = np.zeros(w.n, bool)
        there[places[n - 1] + n - 1] = True
        longer = np.log(np.maximum(counts[n - 1], 1)) - np.log(np.maximum(history, 1))
        best = np.where(seen, longer, best + np.where(there, math.log(backoff), 0.0))
    out = np.zeros(len(texts))
    some = np.flatnonzero(w.counts())
    if len(some):
        out[some] = np.add.reduceat(best, w.first[some])
    return out


def lm_scores(docs: DataFrame, order: int = 3, least: int = 2, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_words, log_score): the sum of the natural logarithms of each word's score.

    docs: doc_id, text, and any other columns, which are left aside. Counts are over all documents, the scored
    one included; n-grams of two and more words count from `least` occurrences on. A word's score is
    count(n-gram) / count(its history) for the longest n-gram up to `order` words that counts, times `backoff`
    for each longer one that the document has there and that doesn't; for a single word it is its share of all
    words. Documents without words have 0. Rows come out as often as they go in.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, round(size / CHUNK_TEXT))
    buckets = max(4 * partitions(docs.sparkSession), round(size / WORD_BYTES * (order - 0.5) / BUCKET_GRAMS))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)))
    dealt = dealt.mapInArrow(press, "chunk long, doc_id long, z binary")
    groups = dealt.groupBy("chunk")

    def asking(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([ask(texts_of(table), table["chunk"][0].as_py(), order, buckets)])

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            rows = answer(held)
            return pa.record_batch({"bucket": pa.array([at] * len(rows), pa.int32()), "chunk": pa.array([c for c, _ in rows], pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

        at, held = None, []
        for batch in batches:
            for bucket, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != at and held:
                    yield out(held)
                    held = []
                at = bucket
                held.append((chunk, blob.as_py()))
        if held:
            yield out(held)

    asked = groups.applyInArrow(asking, "bucket int, chunk long, blob binary")
    asked = asked.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(answering, "bucket int, chunk long, blob binary")
    counted = docs.mapInArrow(count_words, "words long").agg(F.sum("words")).first()[0] or 0

    def scoring(table: pa.Table, answered: pa.Table) -> pa.Table:
        answered = answered.sort_by("bucket")
        totals = np.concatenate([unpacked(x.as_py(), "<i8")[0] for x in answered["blob"]] or [np.zeros(0, np.int64)])
        texts = texts_of(table)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(Words(texts, hashes=False).counts(), pa.int64()), "log_score": pa.array(score(texts, totals, counted, order, least, backoff), pa.float64())})

    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(scoring, "doc_id long, n_words long, log_score double")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.record_batch({"words": pa.array([Words(part.column("text"), hashes=False).n], pa.int64())})
