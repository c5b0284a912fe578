"""Exact substring dedup by super-k-mers.

A window is `window` consecutive words of a document. Consecutive windows whose least hash of `order`
consecutive words (the minimiser) is the same travel as one packed string to the minimiser's bucket; equal
windows have equal minimisers, so each bucket counts its windows for itself.

A minimiser that a very frequent line or word pair holds would fill one bucket. Minimisers with more than a
share of 2 x HOT_SHARE of all runs are known beforehand from counts over all documents; windows under them
travel one by one, to a bucket by the window's own hash. The list has at most 1 / HOT_SHARE entries.

A share of a large table is a large bucket all the same. So the words of all buckets are counted beforehand, and what
would go to one of more than FULL times the usual size travels window by window too: no bucket grows with the table
because of what many different windows have in common. There are at most 1 / FULL as many such buckets as buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.repeats import BUCKET_WORDS, bucket_of, compare, keyed, remove, repeated, send
from quarry.llm.shared import partitions
from quarry.llm.words import Words, chunks, mix, sliding_min, whole, windows

HOT_SHARE = 1 / 4000
#: How many times its usual words a bucket may have.
FULL = 8
NONE = np.zeros(0, np.uint64)


def runs(w: Words, window: int, order: int, hot: np.ndarray = NONE, buckets: int = 1, full: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a minimiser: first word, end, key, and whether it is a window that travels by itself."""
    v = whole(w, window)
    if not len(v):
        return v, v, v.astype(np.uint64), v.astype(bool)
    least = sliding_min(windows(w.h, order), window - order + 1)[v]
    key = least
    lone = np.zeros(len(v), bool)
    if len(hot) or len(full):
        lone = np.isin(least, hot) | np.isin(bucket_of(least, buckets), full)
        key = np.where(lone, mix(windows(w.h, window)[v] ^ np.uint64(1)), least)
    new = np.ones(len(v), bool)
    new[1:] = (np.diff(v) != 1) | (least[1:] != least[:-1]) | lone[1:]
    at = np.flatnonzero(new)
    return v[at], v[at] + np.diff(at, append=len(v)) + window - 1, key[at], lone[at]


def frequent(docs: DataFrame, window: int, order: int) -> tuple[int, np.ndarray]:
    """The number of words in runs, and the minimisers of more than 2 x HOT_SHARE of the runs.

    Each chunk tells its minimisers of more than HOT_SHARE of its runs; what has twice that share of all runs
    has at least half of its runs in such chunks, and so a sum over HOT_SHARE.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                a, b, key, _ = runs(Words(part.column("text")), window, order)
                least, n = np.unique(key, return_counts=True)
                often = n > max(HOT_SHARE * len(key), 1)
                yield pa.record_batch({"key": pa.array([None, *least[often].view(np.int64).tolist()], pa.int64()), "runs": pa.array([len(key), *n[often].tolist()], pa.int64()), "words": pa.array([int((b - a).sum()), *[0] * int(often.sum())], pa.int64())})

    sums = docs.mapInArrow(tally, "key long, runs long, words long").groupBy("key").agg(F.sum("runs").alias("runs"), F.sum("words").alias("words"))
    # no more than 1 / HOT_SHARE keys can have a greater share; the row of totals comes first
    rows = sums.orderBy(F.col("key").isNotNull(), F.desc("runs")).limit(1 + int(1 / HOT_SHARE)).collect()
    if not rows:
        return 0, np.zeros(0, np.uint64)
    return rows[0]["words"], np.array([r["key"] for r in rows[1:] if r["runs"] > rows[0]["runs"] * HOT_SHARE], np.int64).view(np.uint64)


def crowded(docs: DataFrame, window: int, order: int, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that would have more than FULL * BUCKET_WORDS words; they have more than FULL / buckets of all words each."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                a, b, key, lone = runs(Words(part.column("text")), window, order, hot)
                found, at = np.unique(bucket_of(key[~lone], buckets), return_inverse=True)
                words = np.bincount(at, (b - a)[~lone], len(found)).astype(np.int64)
                yield pa.record_batch({"bucket": pa.array(found.astype(np.int64)), "words": pa.array(words)})

    sums = docs.mapInArrow(tally, "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words"))
    return np.array([r["bucket"] for r in sums.where(F.col("words") > FULL * BUCKET_WORDS).select("bucket").collect()], np.uint64)


def dedup_substrings(docs: DataFrame, window: int = 20, order: int = 4) -> DataFrame:
    """Removes each word covered by a window whose words also start earlier, in order of (doc_id, place).

    docs: doc_id, text, and any other columns, which are left aside. Returns doc_id, n_words, n_removed and
    kept_text (the words left, joined by one space). Windows are judged on the input. A null or empty text has
    no words. Rows with a null doc_id come after all others; rows of one doc_id don't remove from one another
    what starts at the same place. Rows come out as often as they go in.
    """
    docs = keyed(docs)
    total, hot = frequent(docs.select("text"), window, order)
    buckets = max(4 * partitions(docs.sparkSession), total // BUCKET_WORDS)
    full = crowded(docs.select("text"), window, order, hot, buckets)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                a, b, key, _ = runs(w, window, order, hot, buckets, full)
                out = list(send(w, np.array(part.column("doc_id")), np.array(part.column("th")), a, b, key, window, buckets))
                yield pa.record_batch({"bucket": pa.array([x for x, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return remove(docs, compare(docs.mapInArrow(split, "bucket int, blob binary"), lambda blobs: repeated(blobs, window)), window)
