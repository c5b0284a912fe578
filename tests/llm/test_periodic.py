import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import words

from quarry.llm.periodic import longest, periodic_runs, runs_of, sorted_suffixes, with_period


def brute_runs(s, least=6, periods=4):
    """Stretches of equal words q apart, for each q; of the same stretch the least q."""
    found = {}
    for q in range(1, len(s) // periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (1, 3), (9, 2), (12, 5)])
def test_runs_of(least, periods):
    r = random.Random(least)
    for _ in range(600):
        k, n = r.choice([1, 2, 3, 6]), r.randrange(1, 70)
        s = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randrange(3)):
            p, a = r.randrange(1, 6), r.randrange(n)
            for i in range(a + p, n):
                s[i] = s[i - p]
        assert [tuple(map(int, x)) for x in zip(*runs_of(np.array(s), least, periods), strict=True)] == brute_runs(s, least, periods)


def test_suffixes():
    s = np.array([1, 2, 1, 2, 1, 1, 2, 9])
    assert sorted_suffixes(s)[0].tolist() == sorted(range(8), key=lambda i: s[i:].tolist())


def test_fibonacci_words():
    """Words that are full of repeats: every second stretch recurs, and runs nest."""
    a, b = [1], [1, 2]
    while len(b) < 900:
        a, b = b, b + a
    for s in (b, [x for i in range(12) for x in (b[: 8 + i % 3], b[: 8 + i % 3])[i % 2]]):
        assert [tuple(map(int, x)) for x in zip(*runs_of(np.array(s), 4, 2), strict=True)] == brute_runs(s, 4, 2)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as runs", "'x' as collapsed", "2 as n_words", "3 as row", "4 as `a.b`").repartition(3)


def test_rows(spark):
    rows = [(1, "a b c " * 10), (1, "a b c " * 10), (2, None), (3, ""), (4, " \n\t"), (5, "z " * 5000), (None, "q r " * 4), (6, "é x é x\n" * 6), (7, "one two three"), (8, ("k " * 8 + "m ") * 5), (9, "a b a b a b a"), (10, "x" * 100_000)]
    got = periodic_runs(table(spark, rows)).select("row.doc_id", "row.`a.b`", "runs", "n_words", "collapsed").collect()
    want = []
    for d, t in rows:
        w = words(t)
        runs = brute_runs(w)
        want.append((d, 4, [tuple(x) for x in runs], len(w), brute_collapsed(w, runs)))
    assert sorted([(d, x, [tuple(y) for y in runs], n, c) for d, x, runs, n, c in got], key=repr) == sorted(want, key=repr)
    best = {x.doc_id: x.b for x in periodic_runs(table(spark, rows)).select("row.doc_id", longest("runs").alias("b")).collect()}
    assert best[2] is None and best[9] is None and tuple(best[5]) == (0, 5000, 1) and tuple(best[8]) == (0, 45, 9)
    assert periodic_runs(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(table(spark, rows), periods=1)


def test_query(spark, sf):
    """The query's columns by a plain version over its whole table."""
    from quarry.llm.queries import op13_periodic_runs

    want, changed = set(), 0
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = words(t)
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        told = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.add((d, len(runs), *best, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()))
    assert changed > 5
    assert set(map(tuple, op13_periodic_runs(spark, sf).collect())) == want


def test_period_of_no_id(spark):
    rows = [(None, "a b c"), (0, None), (0, " ")]
    got = with_period(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
