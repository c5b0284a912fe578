import random
from collections import Counter

import numpy as np
import pytest
from brute import words
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quarry.llm.embedding_dedup import linked_vectors
from quarry.llm.near_dedup import aligned, near_duplicates


def edits(a, b):
    """The whole table of edits, row by row."""
    ids = {}
    a, b = ([ids.setdefault(x, len(ids)) for x in w] for w in (a, b))
    steps = np.arange(len(b) + 1)
    row = steps
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (np.array(b, int) != x))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def may_join(a, b, share):
    """Whether a and b align, by a table of all edits."""
    return edits(a, b) <= int((1 - share) * max(len(a), len(b)) + 1e-9)


@settings(max_examples=600, deadline=None, derandomize=True)
@example([1], [0, 1], 0.5)
@example([3, 5, 1, 2], [5, 3, 5, 1, 2], 0.8)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.sampled_from([0.8, 0.5, 0.3]))
def test_aligned(a, b, share):
    assert aligned(a, b, share) == may_join(a, b, share)


@pytest.mark.parametrize("where", ["front", "end", "scattered"])
@pytest.mark.parametrize("n", [5, 19, 30, 100, 237])
def test_aligned_insertions(n, where):
    """Words put in, as many as the limit allows and one more, either text first."""
    r = random.Random(n)
    a = [r.randrange(n) for _ in range(n)]
    most = max(k for k in range(n) if k <= int(0.2 * (n + k) + 1e-9))
    for k in (1, most, most + 1):
        b = list(a)
        for _ in range(k):
            b.insert({"front": 0, "end": len(b), "scattered": r.randrange(len(b) + 1)}[where], 1000 + r.randrange(50))
        assert aligned(a, b, 0.8) == aligned(b, a, 0.8) == may_join(a, b, 0.8) == (k <= most)


def classes(rows, links):
    up = {i: i for i in range(len(rows))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        up[root(j)] = root(i)
    groups = {}
    for i in up:
        groups.setdefault(root(i), []).append(rows[i])
    return {x: min(g) for g in groups.values() for x in g}


def brute_near(rows, share=0.8):
    w = [words(t) for _, t in rows]
    found = []
    for i in range(len(w)):
        for j in range(i):
            big = max(len(w[i]), len(w[j]))
            same = sum((Counter(w[i]) & Counter(w[j])).values())
            # words that one text alone has are edits: a bound that spares the table of most pairs
            if w[i] and w[j] and big - same <= (1 - share) * big + 1e-9 and may_join(w[i], w[j], share):
                found.append((j, i))
    return classes([d for d, _ in rows], found)


def test_near_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute_near(rows)


def test_near_cases(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(100 + i, common + " " + " ".join(f"v{r.randrange(5000)}" for _ in range(60))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "one three"), (206, "a b c d e"), (207, "a b c d f"), (208, "z " * 5000), (209, "z " * 4999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as v", "2 as g").repartition(5)
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    want = brute_near(rows)
    assert got == want


def test_near_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q"), (2, "a b c")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 1, False)], key=repr)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("grid,tile", [(None, 1500), (2, 7), (3, 50)])
def test_vectors(spark, grid, tile):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 16))
    x = np.concatenate([x, x[:20] + r.normal(scale=0.06, size=(20, 16)), x[:10], np.repeat(x[:1], 30, 0) + r.normal(scale=0.03, size=(30, 16)), x[3:4] * 7]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as v").repartition(3)
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in linked_vectors(df, 0.95, grid=grid, tile=tile).collect()}
    y = x.astype(float)
    u = y / np.sqrt((y * y).sum(1))[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    least = classes(list(range(len(u))), np.argwhere(near).tolist())
    want = {i: (int(near[i].sum()), least[i], least[i] == i) for i in range(len(u))}
    want |= {i: (0, i, True) for i in (900, 901, 902, 903, 904, 907)} | {905: (1, 905, True), 906: (1, 905, False)}
    assert got == want


def test_vectors_empty(spark):
    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
