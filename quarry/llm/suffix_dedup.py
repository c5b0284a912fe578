"""Suffix-array dedup on a sparse set of suffixes.

Kept are the suffixes that start where the hash of `anchor` words is least among all such places of a
passage of `passage` words: two equal passages keep a suffix at the same place, about one in
(passage - anchor) / 2 words is kept, and each kept suffix stands for the passages around it.

1. Suffixes are compared by their first `anchor` words: only those that another suffix shares go on.
2. These travel with the words that a match can reach left and right (at most passage - anchor to the left
   and passage to the right), and meet the suffixes of the same anchor in one bucket.
3. There the suffixes are sorted, and neighbours compared: the words that each has in common with the next one tell which
   suffixes agree to any depth. Matches are extended to the left in the same way, by the order of the words before the
   suffixes, read backwards. A passage that starts o words before a suffix is the same for those that agree in o words
   to the left and in passage - o to the right.

An anchor with more than `hot` suffixes is dealt out again by the passages themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.repeats import compare, joined, keyed, remove, send, unpacked
from quarry.llm.shared import cut, partitions
from quarry.llm.substring_dedup import runs
from quarry.llm.words import Words, chunks, mix, windows

NONE = np.zeros(0, np.uint64)
#: Words that a bucket should hold; a suffix there takes some 700 bytes while it is sorted.
BUCKET_WORDS = 400_000


def suffixes(docs: DataFrame, passage: int, anchor: int) -> DataFrame:
    """(doc_id, th, a, n, key, copies): kept suffixes; those of one anchor in a row are one row, with the words around."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                a, b, key, _ = runs(w, passage, anchor, NONE)
                d = w.doc[a]
                # a run can hold its anchor at several places
                n = b - a - anchor + 1
                first = np.cumsum(n) - n
                place = np.repeat(a - first, n) + np.arange(n.sum())
                here = windows(w.h, anchor)[place] == np.repeat(key, n)
                copies = np.add.reduceat(here, first, dtype=np.int32) if len(a) else np.zeros(0, np.int32)
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(d)), "th": part.column("th").take(pa.array(d)), "a": pa.array(a - w.first[d], pa.int32()), "n": pa.array(b - a, pa.int32()), "key": pa.array(key.view(np.int64)), "copies": pa.array(copies)})

    return docs.mapInArrow(keep, "doc_id long, th int, a int, n int, key long, copies int")


def numbered(w: Words) -> np.ndarray:
    """A number from 1 on for each word, the same for the same bytes only."""
    _, first, number = np.unique(w.h, return_index=True, return_inverse=True)
    least = first[number]  # the first word of each hash
    odd = w.length != w.length[least]
    here, k = np.flatnonzero(~odd & (least != np.arange(w.n))), 0
    while len(here):
        odd[here] |= w.text[w.at[here] + k] != w.text[w.at[least[here]] + k]
        k += 1
        here = here[w.length[here] > k]
    if odd.any():  # different words of one hash
        text, names = w.text.tobytes(), {}
        number = np.array([names.setdefault(text[a : a + n], len(names)) for a, n in zip(w.at.tolist(), w.length.tolist(), strict=True)])
    return number.astype(np.uint32) + np.uint32(1)


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers, and how many numbers each has in common with the one before."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}")[:, 0], kind="stable")
    common = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 100_000):
        to = min(at + 100_000, len(rows))
        same = rows[order[at:to]] == rows[order[at - 1 : to - 1]]
        common[at:to] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, common


def agreeing(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A class for each row: those that agree in `depth` numbers have one, and lie together in the order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def matched(blobs: list[bytes], passage: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, th, start, n) of the passages of a bucket whose words also start earlier."""
    (doc, th, start, length), known, w = unpacked(blobs)
    if not len(doc):
        return tuple(known)
    first = np.cumsum(length) - length
    # suffixes: all places of a run where the anchor's hash is least
    n = length - anchor + 1
    run = np.repeat(np.arange(len(n)), n)
    at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    h = windows(w.h, anchor)[at]
    kept = h == np.minimum.reduceat(h, np.cumsum(n) - n)[run]
    run, at = run[kept], at[kept]
    # a passage belongs to the first suffix in it
    begin = np.where(np.diff(run, prepend=-1) == 0, np.concatenate([[0], at[:-1] + 1]), first[run])
    left, right = np.minimum(at - begin, passage - anchor), (first + length)[run] - at
    words = np.concatenate([numbered(w), np.zeros(1, np.uint32)])  # the last for what lies outside
    steps = np.arange(passage)
    there = at[:, None] + steps
    after = in_order(words[np.where(steps < right[:, None], there, -1)])
    steps = np.arange(1, passage - anchor + 1)
    there = at[:, None] - steps
    before = in_order(words[np.where(there >= first[run][:, None], there, -1)])
    del there
    ids, places = doc[run], start[run] + at - first[run]
    r, p = [], []
    for o in range(passage - anchor + 1):
        some = np.flatnonzero((left >= o) & (right >= passage - o))
        one = agreeing(*after, passage - o)
        some = some[np.bincount(one[some], minlength=len(at) + 1)[one[some]] > 1]
        one = one[some] * (len(at) + 1) + agreeing(*before, o)[some]
        order = np.lexsort((places[some], ids[some], one))
        some, one = some[order], one[order]
        new = np.flatnonzero(np.diff(one, prepend=-1))
        leader = some[np.repeat(new, np.diff(new, append=len(some)))]
        some = some[(ids[some] != ids[leader]) | (places[some] != places[leader])]
        r.append(run[some])
        p.append(at[some] - o - first[run[some]])
    return joined(known, doc, th, start, np.concatenate(r), np.concatenate(p))


def dedup_suffixes(docs: DataFrame, passage: int = 50, anchor: int = 12, hot: int = 4096, carry: bool = False) -> DataFrame:
    """Removes the words of every passage of at least `passage` words that also starts earlier.

    Earlier is by (doc_id, place); the first occurrence stays. docs: doc_id, text, and any other columns,
    which are left aside. Returns doc_id, n_words, n_removed and kept_text (the words left, joined by one
    space). Null and empty texts have no words; rows with a null doc_id come last; rows of one doc_id don't
    remove from one another what starts at the same place. Rows come out as often as they go in. With
    carry, text and rest (the other columns) come along.
    """
    whole, docs = keyed(docs, carry), keyed(docs)
    found = cut(suffixes(docs, passage, anchor), "suffixes")
    often = found.groupBy("key").agg(F.sum("copies").alias("all")).where("all > 1")
    shared = cut(found.join(often, "key").select("doc_id", "th", F.struct("a", "n", (F.col("all") > hot).alias("alone")).alias("s"), "n"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(docs.sparkSession), total // BUCKET_WORDS)
    places = shared.groupBy("doc_id", "th").agg(F.collect_list("s").alias("places"))
    near = docs.join(places.hint("shuffle_hash"), ["doc_id", "th"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                lists = part.column("places")
                flat = lists.flatten()
                d = np.repeat(np.arange(part.num_rows), np.array(pc.list_value_length(lists)))
                a = np.array(flat.field("a"), np.int64) + w.first[d]
                b = a + np.array(flat.field("n"), np.int64)
                alone = np.array(flat.field("alone").cast(pa.uint8()), bool)
                starts = windows(w.h, anchor)
                key = np.array([starts[x : y - anchor + 1].min() for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
                one = np.repeat(a[alone], (b - a)[alone] - passage + 1)
                n = (b - a)[alone] - passage + 1
                one = one + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                key = np.concatenate([key[~alone], mix(windows(w.h, passage)[one] ^ np.uint64(1))])
                out = list(send(w, np.array(part.column("doc_id")), np.array(part.column("th")), np.concatenate([a[~alone], one]), np.concatenate([b[~alone], one + passage]), key, passage, buckets))
                yield pa.record_batch({"bucket": pa.array([x for x, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return remove(whole, compare(near.mapInArrow(split, "bucket int, blob binary"), lambda blobs: matched(blobs, passage, anchor)), passage)
