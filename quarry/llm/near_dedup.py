"""Near-dedup by Order MinHash, verified by banded alignment.

Two documents are linked if their words align with a similarity of 0.8 or more: 1 - edits / words of the
longer, an edit being one word put in, left out or changed.

A document's k-mers are runs of five words, labelled with how often they have come before. Each of `sketches`
hashes picks the `2` labelled k-mers of least hash and keeps them in the order of the text, so a sketch is shared
by texts that hold the same words in the same order. Texts of fewer than five words have one k-mer. MORE sketches of runs of
FINE words find pairs of scattered edits. Texts of up to EXACT words also meet by blocks: of a text cut in one block
more than the edits allowed, one block at least is left whole in each text that aligns, not far from its place.

Documents of the same words are one class and need no search. Classes that share a sketch form a group, in
which all are compared with the least first: a star of pairs, not all pairs. A group whose members links join is done.
While the others hold many pairs that no links join, up to ROUNDS more stars are drawn about members that a hash picks, as long as these join many; then
every pair of theirs that no links join is compared, unless lengths or counts of words show that it can't align. Both are
bounds, so the classes are those of all pairs of all groups; such pairs can grow with the square of a group in which few align.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.repeats import NO_ID, keyed
from quarry.llm.shared import components, cut
from quarry.llm.words import Words, chunks, mix, windows, whole

#: Words of a run, and number, of the sketches that find scattered edits.
FINE, MORE = 3, 48
#: Words of the longer of two texts that blocks find for certain.
EXACT = 29
#: Counters of a text's print, by hash of words, and the sums of these that are looked at first.
COUNTERS, COARSE = 1024, 128
#: Stars about picked members at most, and the pairs for each member that need no star before all are compared.
ROUNDS, FEW = 6, 16
#: Part of a star's pairs that must align for another star before all pairs are compared.
YIELD = 0.25
#: Members of a group that are compared at a time.
TILE = 4000


def ranks(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each hash has come before in its document."""
    same = mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(same, kind="stable")
    new = np.flatnonzero(np.diff(same[order], prepend=~same[order][:1]))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
    return out


def sketch(w: Words, k: int, sketches: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with words, and the sketches of each."""
    counts = w.counts()
    docs = np.flatnonzero(counts)
    if not len(docs):
        return docs, np.zeros((0, sketches), np.uint64)
    place = whole(w, k)
    h = windows(w.h, k)
    short = docs[counts[docs] < k]
    for d in short:  # all the words are the one k-mer
        h[w.first[d]] = hash_of(w.h[w.first[d] : w.first[d + 1]])
    place = np.sort(np.concatenate([place, w.first[short]]))
    h, doc = h[place], w.doc[place]
    labelled = mix(h + ranks(h, doc).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(doc, docs)
    size = np.diff(first, append=len(doc))
    row = np.repeat(np.arange(len(docs)), size)
    out = np.empty((len(docs), sketches), np.uint64)
    # 32 bits choose the k-mers, all 64 name them
    labelled, most = (labelled >> np.uint64(32)).astype(np.uint32), np.uint32((1 << 32) - 1)
    seeds = mix(np.arange(seed, seed + 2 * sketches).astype(np.uint64) + np.uint64(77)).astype(np.uint32)
    few = np.minimum(size, 2)
    # the two least of a text are nearly always among those under a bound that about 16 pass
    bound = np.where(size > 16, 16 * ((1 << 32) // np.maximum(size, 16)) - 1, (1 << 32) - 1).astype(np.uint32)[row]
    for i in range(sketches):
        g = (labelled ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint32(1))
        some = np.flatnonzero(g <= bound)
        counts = np.bincount(row[some], minlength=len(docs))
        if (counts < few).any():
            some, counts = np.arange(len(g)), size
        g, own = g[some], row[some]
        at = []
        for _ in range(2):
            hit = np.flatnonzero(g == np.minimum.reduceat(g, np.cumsum(counts) - counts)[own])
            hit = hit[np.diff(own[hit], prepend=-1) != 0]  # of equal ones the first
            at.append(some[hit])
            g[hit] = most
        a, b = np.minimum(*at), np.maximum(*at)
        out[:, i] = mix(mix(h[a] + np.uint64(i)) + h[b])
    return docs, out


def hash_of(h: np.ndarray) -> np.uint64:
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(np.array([out * np.uint64(31) + x]))[0]
    return out


def blocks_of(h: list[int], share: float) -> list[int]:
    """Keys of a text's words h, of which two texts of EXACT words at most share one if they align.

    The shorter text is cut in one block more than the edits allowed by the longer's length. The longer one is asked for
    block i no more than i places off from the start, and no more than the edits left from the end.
    """
    n, keys = len(h), set()
    allowed = lambda m: int((1 - share) * m + 1e-9)

    def cuts(m: int, edits: int) -> list[tuple[int, int]]:
        ends = [m * i // (edits + 1) for i in range(edits + 2)]
        return list(zip(ends, ends[1:]))

    for edits in {allowed(m) for m in range(n, EXACT + 1) if n >= m - allowed(m)} - {0}:
        keys.update(hash((n, edits, i, *h[a:b])) for i, (a, b) in enumerate(cuts(n, edits)))
    edits = allowed(n)
    for m in range(max(1, n - edits), n + 1) if edits and n <= EXACT else ():
        for i, (a, b) in enumerate(cuts(m, edits)):
            low, high = max(a - i, a + n - m - (edits - i), 0), min(a + i, a + n - m + (edits - i), n - (b - a))
            keys.update(hash((m, edits, i, *h[at : at + b - a])) for at in range(low, high + 1))
    return sorted(keys)


def signs(w: Words, k: int, share: float, sketches: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents with words, and of each the keys of the groups that it is in."""
    rows, sk = sketch(w, k, sketches, seed)
    fine = sketch(w, FINE, MORE, seed + 1)[1] ^ np.uint64(FINE)
    sk = np.concatenate([sk, fine], axis=1).view(np.int64)
    counts = w.counts()[rows]
    return rows, [np.concatenate([x, np.array(blocks_of(w.h[a : a + n].tolist(), share), np.int64)]) if n <= EXACT else x for x, a, n in zip(sk, w.first[rows].tolist(), counts.tolist(), strict=True)]


def signatures(docs: DataFrame, k: int, share: float, sketches: int, seed: int) -> DataFrame:
    """(doc_id, th, node, n, sk) of documents with words; node is a digest of the words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                rows, sk = signs(w, k, share, sketches, seed)
                low, high = w.span(w.first[rows], w.first[rows + 1]) if len(rows) else (rows, rows)
                text = w.text.tobytes()
                nodes = [hashlib.blake2b(text[a:b], digest_size=16).hexdigest() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sk]))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sk)]), pa.int32()), flat)
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(rows)), "th": part.column("th").take(pa.array(rows)), "node": pa.array(nodes, pa.string()), "n": pa.array(w.counts()[rows], pa.int64()), "sk": lists})

    return docs.mapInArrow(sign, "doc_id long, th int, node string, n long, sk array<long>")


def banded(a: list, b: list, band: int) -> int:
    """Edits between a and b if no more than band, else a number over band; bit-parallel, a bit for each row of the band.

    Each column of the band is a number: vp has the rows where the distance is one more than above, vn one less.
    """
    n, width = len(a), 2 * band + 1
    most = 2 * band + max(0, len(b) - n)  # edits can still fall by the columns of the last row
    full = (1 << width) - 1
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    vp, vn, edits = full >> band << band, 0, band
    low, last = 1 << width - 1, 1 << width - 2
    for j, y in enumerate(b):
        x = at.get(y, 0)
        x = (x >> j - band if j >= band else x << band - j) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j < n - band:  # along the band's lower edge
            edits += not d0 & low
        else:  # along the last row
            edits += bool(hp & last) - bool(hn & last)
            last >>= 1
        if edits > most:
            return band + 1
        d0 >>= 1
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
    return edits


def shared(counts: dict, b: list) -> int:
    """How many of the words of b the counts of a's words hold."""
    left, n = dict(counts), 0
    for x in b:
        if left.get(x):
            left[x] -= 1
            n += 1
    return n


def aligned(a: list, b: list, share: float, counts: dict | None = None) -> bool:
    """Whether a and b align with at most (1 - share) * max(len) edits; counts: of a's words, if known.

    The band widens from a few rows to the edits allowed.
    """
    limit = int((1 - share) * max(len(a), len(b)) + 1e-9)
    if a == b or not limit:
        return a == b
    if abs(len(a) - len(b)) > limit or max(len(a), len(b)) - shared(counts or Counter(a), b) > limit:
        return False
    if limit >= min(len(a), len(b)):  # so short, or so few words in common, that the band is all rows
        a, b = [*a, *[-1] * (limit + 1)], [*b, *[-1] * (limit + 1)]
    band = max(abs(len(a) - len(b)), 4)
    while band < limit:
        if banded(a, b, band) <= band:
            return True
        band *= 6
    return banded(a, b, limit) <= limit


def pressed(texts: DataFrame) -> DataFrame:
    """(v, z): the texts (v, text), each compressed, since they travel several times."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.record_batch({"v": part.column("v"), "z": pa.array([zstandard.compress(x.as_py().encode(), 6) for x in part.column("text")], pa.binary())})

    return texts.mapInArrow(press, "v long, z binary")


def verify(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) that align; texts: (v, z)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids: dict[bytes, int] = {}
                held: dict[int, tuple[list[int], Counter]] = {}
                read = lambda z: [ids.setdefault(x, len(ids)) for x in zstandard.decompress(z.as_py()).split()]
                for a, b, s, t in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("s"), part.column("t"), strict=True):
                    if a not in held:  # pairs of one text come together
                        held = {a: (words := read(s), Counter(words))}
                    if aligned(held[a][0], read(t), share, held[a][1]):
                        out.append((a, b))
            yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    pairs = pairs.join(texts.select(F.col("v").alias("b"), F.col("z").alias("t")), "b").join(texts.select(F.col("v").alias("a"), F.col("z").alias("s")), "a")
    return pairs.select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


def prints(texts: DataFrame) -> DataFrame:
    """(v, n, print): of each text (v, z) its words and COUNTERS numbers of 4 bits, each how many of its words have one hash, 15 at most.

    An edit raises one number and lowers one at most by 1, so the numbers bound the edits between two texts from
    below; so do sums of some of the numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w = Words(pa.array([zstandard.decompress(x.as_py()) for x in part.column("z")], pa.binary()).cast(pa.string()))
                counts = np.bincount(w.doc * COUNTERS + (w.h % np.uint64(COUNTERS)).astype(np.int64), minlength=part.num_rows * COUNTERS)
                rows = np.minimum(counts, 15).astype(np.uint8).reshape(part.num_rows, -1, 2)
                rows = rows[:, :, 0] | rows[:, :, 1] << 4
                yield pa.record_batch({"v": part.column("v"), "n": pa.array(w.counts(), pa.int64()), "print": pa.array([zstandard.compress(x.tobytes()) for x in rows], pa.binary())})

    return texts.mapInArrow(count, "v long, n long, print binary")


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each print, COARSE sums and COUNTERS numbers."""
    opened = zstandard.ZstdDecompressor().decompress
    packed = np.frombuffer(b"".join(map(opened, column.to_pylist())), np.uint8).reshape(len(column), COUNTERS // 2)
    fine = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(column), COUNTERS).astype(np.int8)
    return fine.reshape(len(column), COARSE, -1).sum(axis=2, dtype=np.int8), fine


def edits_at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.maximum(np.maximum(d, 0).sum(axis=1, dtype=np.int64), np.maximum(-d, 0).sum(axis=1, dtype=np.int64))


def allowed(n: np.ndarray, share: float) -> np.ndarray:
    return ((1 - share) * n + 1e-9).astype(np.int64)


def bounded(pairs: DataFrame, share: float) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb, pa, pb) that lengths and prints don't exclude."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                most = allowed(np.maximum(np.array(part.column("na")), np.array(part.column("nb"))), share)
                good = pa.array(edits_at_least(numbers(part.column("pa"))[1], numbers(part.column("pb"))[1]) <= most)
                yield pa.record_batch({x: part.column(x).filter(good) for x in "ab"})

    pairs = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * share - 1e-9)
    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(check, "a long, b long")


def may_align(pairs: DataFrame, marked: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) that lengths and prints don't exclude; marked: (v, n, print)."""
    for x in "ba":
        pairs = pairs.join(marked.select(F.col("v").alias(x), F.col("n").alias("n" + x), F.col("print").alias("p" + x)), x)
    return bounded(pairs, share)


def possible(rows: pa.Table, share: float) -> pa.Table:
    """Pairs (a, b) of rows (g, x, y, t, v, n, root, gs, print) of one g that may align and have different roots; where x <> y, of different t.

    gs are all the groups of a row, and a pair comes out in the first group only that both are in.
    """
    g, x, y, t, v, n, root = (np.asarray(rows.column(c)) for c in ("g", "x", "y", "t", "v", "n", "root"))
    order = np.lexsort((n, g))
    g, t, v, n, root, across = g[order], t[order], v[order], n[order], root[order], (x != y)[order]
    coarse, fine = (x[order] for x in numbers(rows.column("print").combine_chunks()))
    most = allowed(n, share)
    lists = rows.column("gs").to_pylist()
    before = [frozenset(x for x in lists[i] if x < own) for i, own in zip(order.tolist(), g.tolist(), strict=True)]
    out: list[list[np.ndarray]] = [[], []]
    edge = np.flatnonzero(np.diff(g, append=~g[-1:])) + 1
    end = edge[np.searchsorted(edge, np.arange(len(g)), "right")]
    for i in range(len(g)):
        to = i + 1 + int(np.searchsorted(n[i + 1 : end[i]] * share - 1e-9, n[i], "right"))
        j = np.arange(i + 1, to)[root[i + 1 : to] != root[i]]
        if len(j) and across[i]:
            j = j[t[j] != t[i]]
        if len(j):
            j = j[edits_at_least(coarse[j], coarse[i]) <= most[j]]
            j = j[edits_at_least(fine[j], fine[i]) <= most[j]]
            j = j[np.array([before[i].isdisjoint(before[at]) for at in j.tolist()], bool)]
            out[0].append(np.minimum(v[i], v[j]))
            out[1].append(np.maximum(v[i], v[j]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def all_pairs(left: DataFrame, rows: int, share: float, tile: int) -> DataFrame:
    """Pairs (a, b) of members (g, size, v, n, root, gs, print) of one group that may align and have different roots. Large groups are dealt out in tiles."""
    tiles = F.ceil(F.col("size") / tile).cast("int")
    left = left.withColumn("t", F.pmod(F.xxhash64("v", "g"), tiles).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), tiles - 1)))
    left = left.withColumn("x", F.least("t", "u")).withColumn("y", F.greatest("t", "u"))
    left = left.withColumn("k", F.when(F.col("size") <= tile, F.pmod("g", F.lit(max(48, rows // 20000)))).otherwise(F.col("g")))
    dealt = left.select("k", "x", "y", "g", "t", "v", "n", "root", "gs", "print").groupBy("k", "x", "y")
    return dealt.applyInArrow(lambda t: possible(t, share), "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, share: float, tile: int = TILE, few: int = FEW) -> DataFrame:
    """Links (a, b) between nodes, that join all nodes which links of any two of a group join. nodes: (v, n, at, sk)."""
    groups = nodes.select("v", F.explode("sk").alias("s")).select(F.xxhash64("s").alias("g"), "v")
    least = cut(groups.groupBy("g").agg(F.min("v").alias("c"), F.count("*").alias("size")).where("size > 1").select("g", "c"), "least")
    stars = cut(groups.join(least, "g").where("v <> c"), "stars")
    left = stars.select("g", "v").union(least.select("g", F.col("c").alias("v")))
    ends = cut(left.select("v").distinct().join(nodes.select("v", "at.*"), "v"), "ends")
    # rows that repeat lie together, so dropping them moves nothing
    texts = cut(pressed(docs.join(ends.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "v"]).select("v", "text")), "texts")
    marked = cut(prints(texts), "prints")
    done = stars.select(F.col("c").alias("a"), F.col("v").alias("b")).distinct()
    good = cut(verify(cut(may_align(done, marked, share), "pairs"), texts, share), "aligned")

    for turn in range(ROUNDS + 1):
        roots = components(good).select(F.col("node").alias("v"), "root")
        known = [x for x in ("n", "print", "gs") if x in left.columns]
        joined = left.select("g", "v", *known).join(roots, "v", "left").select("g", "v", *known, F.coalesce("root", "v").alias("root"))
        picked = F.min_by(F.struct(F.col("v").alias("c"), F.col("root").alias("r")), F.xxhash64("g", "root", F.lit(turn)))
        undone = joined.groupBy("g").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(v))").alias("same"), F.min("root").alias("low"), F.max("root").alias("high"), picked.alias("p")).where("low <> high")
        undone = undone.groupBy("size", "same").agg(F.min_by(F.struct("g", "p"), "g").alias("one"))  # groups of the same members are one
        left = joined.join(undone.select("one.g", "size", "one.p.*"), "g")
        left = cut(left, "left")
        if not known:  # groups of the same members stay one, so a row's list is good for all turns
            left = cut(left.join(marked.join(left.groupBy("v").agg(F.collect_set("g").alias("gs")), "v"), "v"), "members")
        parts = left.groupBy("g", "root", "size").agg(F.count("*").cast("double").alias("n"))
        rows, pairs = parts.agg(F.sum("n"), F.sum((F.col("size") - F.col("n")) * F.col("n") / 2)).first()
        if not rows:
            return good
        if pairs <= few * rows or turn == ROUNDS:
            break
        star = left.where("root <> r").join(marked.select(F.col("v").alias("c"), F.col("n").alias("nc"), F.col("print").alias("pc")), "c")
        star = star.select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b"), F.col("n").alias("na"), F.col("nc").alias("nb"), F.col("print").alias("pa"), F.col("pc").alias("pb"))
        more = cut(bounded(star, share).distinct().join(done, ["a", "b"], "left_anti"), "more")
        done = done.union(more)
        found = cut(verify(more, texts, share), "aligned")
        good = good.union(found)
        if found.count() < YIELD * more.count():  # stars join too little to go on
            break
    rest = cut(all_pairs(left, int(rows), share, tile).join(done, ["a", "b"], "left_anti"), "rest")
    return good.union(cut(verify(rest, texts, share), "aligned"))


def near_classes(docs: DataFrame, k: int = 5, share: float = 0.8, sketches: int = 32, seed: int = 0) -> DataFrame:
    """(doc_id, th, class_id, kept) for each row; th is the hash of its text. See near_duplicates()."""
    docs = keyed(docs)
    sig = cut(signatures(docs, k, share, sketches, seed), "signatures")
    nodes = sig.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("sk").alias("sk"))
    nodes = cut(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    roots = components(links(docs, nodes, share)).select(F.col("node").alias("v"), "root")
    rooted = nodes.join(roots, "v", "left").select("node", F.coalesce("root", "v").alias("root"), F.col("at.doc_id").alias("least"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    members = sig.select("doc_id", "th", "node").distinct().join(rooted.join(classes, "root").select("node", "class_id"), "node")
    out = docs.select("doc_id", "th").join(members.select("doc_id", "th", "class_id"), ["doc_id", "th"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    null = lambda c: F.when(c != NO_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), "th", null(class_id).alias("class_id"), (class_id == F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, share: float = 0.8, sketches: int = 32, seed: int = 0) -> DataFrame:
    """(doc_id, class_id, kept): classes of documents that links reach; class_id is the least doc_id of a class.

    docs: doc_id, text, and any other columns, which are left aside. One document of a class is kept, the one
    with that doc_id. A document without words (null, empty or white space) is a class of its own. Rows come
    out as often as they go in; rows of one doc_id and one text count as one document. A null doc_id is
    greater than all others: its row is kept only where no other is in its class.
    """
    return near_classes(docs, k, share, sketches, seed).drop("th")
