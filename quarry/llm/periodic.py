"""Periodic runs of words, by a suffix tree and the smaller half of its leaf lists.

A run is a stretch of words with smallest period q, `periods` times q or more and `least` words or more long, that no
neighbouring word extends. Runs are found in two steps:

1. Branching tandem repeats. A node of the suffix tree with d words on its path has the places of those words as its leaf
   list. Two such places d words apart are a tandem repeat; it branches if the word after it isn't the one that would
   extend it. Each repeat shows at a leaf outside the node's largest child, or at the leaf d words before or after one,
   so only the smaller half of each list is looked at: n log n leaves in all.
2. Rotation. What a branching repeat has in common with itself d words on, read to the left, are the repeats that rotate
   it; together they are a maximal stretch of period d. Of the same stretches the one of the smallest period stays: by
   Fine and Wilf's theorem the others' periods are its multiples.

The tree is held as sorted suffixes with what neighbours have in common, of all documents of a chunk at once: each document's
words have numbers of their own, so no node holds two documents. Words that can't be in a run stay out of the tree: all runs of
SEED words of a run occur twice in it, so words outside such runs part the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.llm.shared import WORD
from quarry.llm.suffix_dedup import numbered
from quarry.llm.words import Words, chunks, mix, whole, windows

RUNS = "runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def sorted_suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of numbers s in order, and names of the stretches of 1, 2, 4, ... numbers from each place on (0 past the end).

    s ends with a number that is nowhere else. Each round sorts by twice as many numbers as the one before.
    """
    n = len(s)
    name = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [name.astype(np.int32)], 1
    while True:
        key = name * (n + 2)
        key[: n - step] += name[step:]
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = np.diff(key[order]) != 0
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(new)
        if name[order[-1]] == n:
            return order, levels
        levels.append(name.astype(np.int32))
        step *= 2


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many numbers places a and b (a < b or a > b) have in common from there on, or with back before them."""
    out = np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        # a level's names are of the whole stretch, as the last number is nowhere else
        for _ in range(2 if k == len(levels) - 1 else 1):
            x, y = (a - out - size, b - out - size) if back else (a + out, b + out)
            ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
            same = np.zeros(len(a), bool)
            same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            out[same] += size
    return out


def inner_nodes(lcp: np.ndarray) -> np.ndarray:
    """Rows (depth, first, end, first of the largest child, its end) of the tree's inner nodes but the root, as ranges of sorted suffixes.

    lcp: what each suffix has in common with the one before it.
    """
    out: list[tuple[int, int, int, int, int]] = []
    depths, firsts, bigs, sizes = [0], [0], [0], [0]
    for i, depth in enumerate([*lcp.tolist()[1:], 0], 1):
        child, size = i - 1, 1
        while depths[-1] > depth:
            d, first, big, most = depths.pop(), firsts.pop(), bigs.pop(), sizes.pop()
            if size > most:
                big, most = child, size
            out.append((d, first, i, big, big + most))
            child, size = first, i - first
        if depths[-1] < depth:
            depths.append(depth)
            firsts.append(child)
            bigs.append(child)
            sizes.append(size)
        elif size > sizes[-1]:
            bigs[-1], sizes[-1] = child, size
    return np.array(out, np.int64).reshape(-1, 5)


def branching(s: np.ndarray, order: np.ndarray, nodes: np.ndarray, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(start, depth) of the branching tandem repeats of numbers s, each once."""
    n = len(s)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    starts, depths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.cumsum((nodes[:, 2] - nodes[:, 1]) - (nodes[:, 4] - nodes[:, 3]))
    at = 0
    while at < len(nodes):
        to = max(at + 1, int(np.searchsorted(small, (small[at - 1] if at else 0) + block, "right")))
        depth, first, end, big, big_end = nodes[at:to].T
        # leaves before the largest child, and after it
        low, size = np.concatenate([first, big_end]), np.concatenate([big - first, end - big_end])
        node = np.repeat(np.tile(np.arange(to - at), 2), size)
        leaf = order[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        d = depth[node]
        for i in (leaf, leaf - d):  # a repeat that starts at the leaf, and one whose second half does
            there = np.where(i == leaf, i + d, i)
            ok = (i >= 0) & (there < n)
            r = rank[there[ok]]
            own = node[ok]
            hit = np.flatnonzero(ok)[(r >= first[own]) & (r < end[own])]
            x, y = i[hit], d[hit]
            after = x + 2 * y
            branch = after >= n
            branch[~branch] = s[after[~branch]] != s[x[~branch]]
            starts.append(x[branch])
            depths.append(y[branch])
        at = to
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(depths)], 1), axis=0)
    return found[:, 0], found[:, 1]


def runs_of(s: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of numbers s, by start and period."""
    s = np.append(s, s.max(initial=0) + 1)
    order, levels = sorted_suffixes(s)
    lcp = np.zeros(len(s), np.int64)
    lcp[1:] = common(levels, order[:-1], order[1:])
    start, period = branching(s, order, inner_nodes(lcp))
    end = start + 2 * period
    start = start - common(levels, start, start + period, back=True)
    long = end - start >= np.maximum(least, periods * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def sieve(w: Words, seed: int) -> np.ndarray:
    """Words under runs of `seed` words that their document holds twice or more. Hashes that agree by chance let more words through."""
    at = whole(w, seed)
    h = mix(windows(w.h, seed)[at] + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, name, times = np.unique(h, return_inverse=True, return_counts=True)
    mark = np.zeros(w.n + 1, np.int64)
    twice = at[times[name] > 1]
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + seed, -1)
    return np.cumsum(mark)[:-1] > 0


def runs_in(w: Words, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of the documents of w.

    The seed is as long as a run's shortest stretch that occurs again in it with every place of the run under one: a run has
    m = max(least, periods * q) words, and each stretch of k words in it comes again q words on or back if m >= k + 2q - 1.
    """
    none = np.zeros(0, np.int64)
    seed = min(max(least, periods * q) - 2 * q + 1 for q in range(1, least + 1)) if periods > 2 else 1
    part = sieve(w, max(1, seed))
    words = np.flatnonzero(part)
    if not len(words):
        return none, none, none
    # numbers of a document's own words; where the text was parted, one that is nowhere else
    own = np.unique(numbered(w)[words].astype(np.int64) * (int(w.doc[-1]) + 1) + w.doc[words], return_inverse=True)[1]
    gap = np.flatnonzero((np.diff(words) != 1) | (np.diff(w.doc[words]) != 0)) + 1
    s = np.insert(own, gap, own.max() + 1 + np.arange(len(gap)))
    back = np.insert(words, gap, -1)
    start, length, period = runs_of(s, least, periods)
    return back[start], length, period


def periodic_runs(docs: DataFrame, least: int = 6, periods: int = 4) -> DataFrame:
    """docs with runs, n_words and collapsed, for each row.

    docs: doc_id, text and any other columns; all but text come along in the struct `row`, whatever their names. runs: (start,
    length, period) of each run by start, then period, in words from 0. collapsed: the words, joined by one space, without
    those that any run holds after its first period. Null and empty texts have no words and no runs, and an empty collapsed
    text. Rows don't touch one another, so repeated rows have equal results, and nothing is shuffled. Memory is that of a chunk of
    rows, or of the longest text. periods: 2 at least.
    """
    if periods < 2 or least < 1:
        raise ValueError("periods must be 2 or more, least 1 or more")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    docs = docs.select(rest, "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4_000_000):
                w = Words(part.column("text"))
                start, length, period = runs_in(w, least, periods)
                doc = w.doc[start]
                order = np.lexsort((period, start, doc))
                start, length, period, doc = (x[order] for x in (start, length, period, doc))
                flat = pa.StructArray.from_arrays([pa.array(start - w.first[doc]), pa.array(length), pa.array(period)], fields=list(RUN))
                offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                mark = np.zeros(w.n + 1, np.int64)
                np.add.at(mark, start + period, 1)
                np.add.at(mark, start + length, -1)
                keep = np.cumsum(mark)[:-1] == 0
                kept = w.text[np.repeat(keep, w.length + 1)].tobytes()
                ends = np.concatenate([[0], np.cumsum(np.where(keep, w.length + 1, 0))])[w.first]
                texts = [kept[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.record_batch({"row": part.column("row"), "runs": pa.ListArray.from_arrays(pa.array(offsets), flat), "n_words": pa.array(w.counts(), pa.int64()), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    schema = StructType([StructField("row", docs.schema["row"].dataType), *StructType.fromDDL(RUNS).fields])
    return docs.mapInArrow(find, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then period. Null where there is none."""
    better = lambda x, y: F.when((y["length"] > x["length"]) | x.isNull(), y).otherwise(x)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, better)


def with_period(docs: DataFrame) -> DataFrame:
    """Documents in which every tenth, by a checksum of doc_id, repeats a stretch of its words to the end; a null doc_id's text stays.

    h is the CRC-32 of doc_id in decimal, g = h // 10. If h % 10 = 0, word i from a = g % n on becomes word a + (i - a) % p,
    where p = 1 + (n - a) // (3 + g % 8); n words, numbered from 0.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.select("doc_id", "text", g.alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a"))), " ")
    return docs.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
