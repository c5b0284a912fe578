"""Near-dedup finds all links of a group, and what short texts and scattered edits hide from few sketches."""

import random

import pytest
from test_near import brute_near, classes, may_join

from quarry.llm.near_dedup import EXACT, blocks_of, links, near_duplicates


def edited(w, places, tag):
    return [f"{tag}{i}" if i in places else x for i, x in enumerate(w)]


@pytest.mark.parametrize("tile,few", [(1000, 16), (5, 0)])
def test_group_without_leftovers(spark, tile, few):
    """All are in one group: a chain whose ends don't align, and clusters that align with no centre."""
    r = random.Random(1)
    c = [f"c{i}" for i in range(20)]
    b = edited(c, {1, 7, 13}, "b")
    rows = [c, b, edited(b, {3, 9, 16}, "a")]
    for k in range(4):
        base = [f"k{k}_{i}" for i in range(20 + k)]
        rows += [edited(base, {r.randrange(20)}, f"e{j}_") for j in range(5)]
    rows += [[f"lone{k}_{i}" for i in range(21)] for k in range(3)]
    docs = spark.createDataFrame([(i, 0, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, th int, text string")
    nodes = spark.createDataFrame([(i, len(w), (i, 0), [7, 8]) for i, w in enumerate(rows)], "v long, n long, at struct<doc_id: long, th: int>, sk array<long>")
    found = [(x.a, x.b) for x in links(docs, nodes, 0.8, tile=tile, few=few).collect()]
    want = [(i, j) for j in range(len(rows)) for i in range(j) if may_join(rows[i], rows[j], 0.8)]
    assert set(found) <= set(want)
    assert classes(range(len(rows)), found) == classes(range(len(rows)), want)


def changed(r, a, edits, words):
    b = list(a)
    for _ in range(edits):
        i, kind = r.randrange(len(b)), r.randrange(3)
        if kind:
            b[i : i + 1] = [r.choice(words)] * (kind - 1)
        else:
            b.insert(i, r.choice(words))
    return b


def test_blocks_find_all():
    r = random.Random(2)
    found = 0
    for _ in range(3000):
        words = range(r.choice([2, 4, 50]))
        a = [r.choice(words) for _ in range(r.randrange(5, EXACT + 1))]
        b = changed(r, a, len(a) // 5, words)
        if a != b and len(b) <= EXACT and may_join(a, b, 0.8):
            found += 1
            assert set(blocks_of(a, 0.8)) & set(blocks_of(b, 0.8))
    assert found > 1000


def test_scattered_edits(spark):
    """Pairs at the limit, of all lengths up to 29 words, and some longer ones, against brute force; five words with one edit too."""
    r = random.Random(4)
    rows = [(0, "a b c d e"), (1, "a b c d f")]
    for n in [*range(5, 30), 100, 200]:
        a = [f"w{r.randrange(9000)}" for _ in range(n)]
        b = list(a)
        for i in r.sample(range(n), n // 5):
            b[i] = f"x{r.randrange(9000)}"
        rows += [(10 * n, " ".join(a)), (10 * n + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)
    assert len(set(got.values())) == len(rows) // 2


@pytest.mark.parametrize("where", ["front", "end", "middle", "scattered"])
def test_words_put_in(spark, where):
    """Texts, and each again with 16 % of words put in, before or behind it by id."""
    r = random.Random(where)
    rows = []
    for i in range(60):
        a = [f"w{r.randrange(9000)}" for _ in range(r.randrange(20, 400))]
        b, k = list(a), int(len(a) * 0.16)
        at = {"front": 0, "end": len(a), "middle": len(a) // 2}.get(where)
        for j in range(k):
            b.insert(r.randrange(len(b) + 1) if at is None else at, f"p{r.randrange(9000)}")
        rows += [(2 * i + j, " ".join(x)) for j, x in enumerate(r.sample([a, b], 2))]
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i in range(60) if got[2 * i + 1] != 2 * i]
    assert missed == []
