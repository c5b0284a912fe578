"""Repeated windows of words, counted exactly: what substring dedup and suffix-array dedup have in common.

A *run* is a stretch of consecutive windows of one document, kept as one packed string. Runs travel to
buckets in blobs (the runs that one chunk of documents has for one bucket, zstd-compressed), so a shuffle
row is a few kilobytes and identical runs of a chunk travel once. In a bucket the windows are sorted by
hash and neighbours compared byte for byte.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.llm.shared import partitions
from quarry.llm.words import BASE, INVERSE, Words, chunks, mix, powers, windows

#: Stands for a null doc_id, which sorts after all others.
NO_ID = (1 << 63) - 1
#: Words that a bucket should hold; the number of buckets follows from all words.
BUCKET_WORDS = 1_200_000
#: Of zstd, for blobs.
LEVEL = 4
SPANS = "doc_id long, th int, start int, n int"


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (no nulls), th (of the text, so that rows that repeat an id stay apart), text and, with carry, rest, the other columns."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if carry else []
    return docs.select(*rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("th"), F.col("text"))


def pack(doc: np.ndarray, th: np.ndarray, start: np.ndarray, words: np.ndarray, parts: list[bytes], later: tuple[np.ndarray, ...]) -> bytes:
    """One blob: runs with their text, and windows already known to repeat (doc, th, start, n)."""
    body = [struct.pack("<qq", len(doc), len(later[0]))]
    for ids in (doc, later[0]):
        body.append(np.diff(ids, prepend=ids.dtype.type(0)).astype("<i8").tobytes())
    body += [x.astype("<i4").tobytes() for x in (th, start, words, *later[1:])]
    return zstandard.compress(b"".join(body) + b" ".join(parts), LEVEL)


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    n, m = struct.unpack_from("<qq", raw)
    at, out = 16, []
    for count, kind in ((n, "<i8"), (m, "<i8"), *[(n, "<i4")] * 3, *[(m, "<i4")] * 3):
        out.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
        at += count * int(kind[-1])
    return [np.cumsum(out[0]), *out[2:5]], [np.cumsum(out[1]), *out[5:8]], raw[at:]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(1)) % np.uint64(buckets)


def send(w: Words, doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray, window: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the runs of words a..b. Later copies of a run in the chunk go as spans, without text.

    key: of each run, equal for runs that may share windows.
    """
    if not len(a):
        return
    low, high = w.span(a, b)
    text = w.text.tobytes()
    d = w.doc[a]
    start = a - w.first[d]
    ids, ths = doc[d], th[d]
    # the hash of a run's words, from prefix sums as in windows()
    sums = np.zeros(w.n + 1, np.uint64)
    np.cumsum(w.h * powers(BASE, w.n), out=sums[1:])
    hashed = mix((sums[b] - sums[a]) * powers(INVERSE, w.n + 1)[a] + (b - a).astype(np.uint64))
    order = np.lexsort((start, ids, hashed))
    first = np.ones(len(order), bool)
    first[1:] = hashed[order][1:] != hashed[order][:-1]
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = np.zeros(len(a), bool)
    for i, j in zip(order[~first], lead[~first], strict=True):
        later[i] = (ids[i], start[i]) != (ids[j], start[j]) and text[low[i] : high[i]] == text[low[j] : high[j]]
    bucket = bucket_of(key, buckets)
    order = np.lexsort((start, ids, later, bucket))
    edges = np.flatnonzero(np.diff(bucket[order], prepend=buckets + 1, append=buckets + 1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = order[lo:hi]
        k = part[~later[part]]
        s = part[later[part]]
        yield int(bucket[part[0]]), pack(ids[k], ths[k], start[k], b[k] - a[k], [text[x:y] for x, y in zip(low[k], high[k], strict=True)], (ids[s], ths[s], start[s], b[s] - a[s] - window + 1))


def unpacked(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], Words]:
    """Runs (doc, th, start, words), known spans, and the words of all runs, of a bucket."""
    runs, spans, texts = zip(*map(unpack, blobs), strict=True)
    w = Words(pa.array([b" ".join(t for t in texts if t)], pa.binary()).cast(pa.string()))
    return [np.concatenate([r[i] for r in runs]) for i in range(4)], [np.concatenate([s[i] for s in spans]) for i in range(4)], w


def joined(known: list[np.ndarray], doc: np.ndarray, th: np.ndarray, start: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """The known spans, and those of the windows p of runs r, consecutive ones as one."""
    order = np.lexsort((p, r))
    r, p = r[order], p[order]
    new = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
    mine = (doc[r[new]], th[r[new]], start[r[new]] + p[new], np.diff(new, append=len(r)))
    return tuple(np.concatenate(x) for x in zip(known, mine, strict=True))


def repeated(blobs: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, th, start, n) of the windows of a bucket whose words also start earlier."""
    (doc, th, start, length), known, w = unpacked(blobs)
    if not len(doc):
        return tuple(known)
    text = w.text.tobytes()
    at = np.concatenate([[0], np.cumsum(length)])[:-1]
    n = np.maximum(length - window + 1, 0)
    run = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    word = at[run] + inner
    h = windows(w.h, window)[word]
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    many = order[same[:-1] | same[1:]]
    many = many[np.lexsort((start[run[many]] + inner[many], doc[run[many]], h[many]))]
    low, high = w.span(word[many], word[many] + window)
    group = np.cumsum(np.diff(h[many], prepend=h[many][:1]) != 0) if len(many) else many
    lead = np.flatnonzero(np.diff(group, prepend=-1))
    leader = np.repeat(lead, np.diff(lead, append=len(many)))
    odd = [i for i, (a, b, c, d) in enumerate(zip(low.tolist(), high.tolist(), low[leader].tolist(), high[leader].tolist(), strict=True)) if a != c and text[a:b] != text[c:d]]
    if odd:  # different windows of one hash: group by the words themselves
        seen: dict[tuple, int] = {}
        for i in range(len(many)):
            leader[i] = seen.setdefault((group[i], text[low[i] : high[i]]), i)
    ids, places = doc[run[many]], start[run[many]] + inner[many]
    hit = (ids != ids[leader]) | (places != places[leader])
    return joined(known, doc, th, start, run[many][hit], inner[many][hit])


def compare(blobs: DataFrame, find: Callable[[list[bytes]], tuple[np.ndarray, ...]]) -> DataFrame:
    """Spans of repeated windows from (bucket int, blob binary), as `find` has them; one bucket is in memory at a time."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[bytes]) -> pa.RecordBatch:
            doc, th, start, n = find(held)
            return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "th": pa.array(th, pa.int32()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32())})

        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at and held:
                    yield out(held)
                    held = []
                at = bucket
                held.append(blob.as_py())
        if held:
            yield out(held)

    return blobs.repartition(partitions(blobs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(buckets, SPANS)


def remove(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): documents without the words under spans of windows.

    docs is of keyed(); a document's spans are no more than its words.
    """
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    carry = [docs.schema[c] for c in ("rest", "text") if "rest" in docs.columns]
    joined = docs.join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left")

    def cutout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"), hashes=False)
                counts = w.counts()
                lists = part.column("spans")
                sizes = np.array(pc.list_value_length(lists).fill_null(0))
                flat = lists.flatten()
                d = np.repeat(np.arange(len(counts)), sizes)
                start = np.array(flat.field("start"), np.int64) + w.first[d]
                n = np.array(flat.field("n"), np.int64)
                mark = np.zeros(w.n + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + n + window - 1, -1)
                keep = np.cumsum(mark)[:-1] == 0
                lengths = np.where(keep, w.length + 1, 0)
                kept = w.text[np.repeat(keep, w.length + 1)].tobytes()
                ends = np.concatenate([[0], np.cumsum(lengths)])[w.first]
                removed = counts - np.diff(np.concatenate([[0], np.cumsum(keep)])[w.first])
                texts = [kept[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                rest = {"rest": part.column("rest"), "text": part.column("text")} if carry else {}
                yield pa.record_batch(rest | {"doc_id": part.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    own = [StructField(n, StringType() if n == "kept_text" else LongType()) for n in ("doc_id", "n_words", "n_removed", "kept_text")]
    out = joined.mapInArrow(cutout, StructType(carry + own))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
