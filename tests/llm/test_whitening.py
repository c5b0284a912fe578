import math

import numpy as np
import pytest

from quarry.llm import whitening
from quarry.llm.whitening import triangle, whiten


def brute(rows, most=16):
    """{(vec_id, component): ...} by an eigenvalue decomposition of the covariance; one length."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, total = len(fit), fit.sum(axis=0)
    mean = np.array([float(s) / n for s in total])
    y = np.array(fit - 1_000_000, float) - (mean - 1_000_000)
    y -= y.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    dev = ((n * x - total) ** 2).sum(axis=1)
    white = (np.array(x - 1_000_000, float) - (mean - 1_000_000)) @ v[:, :most] / np.sqrt(e[:most])
    return n, dev, white, e[:most] / e.sum()


def check(got, rows, tolerance=1e-9, most=16):
    n, dev, white, explained = brute(rows, most)
    for c in range(white.shape[1]):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        assert len(own) == len(rows)
        mine = np.array([own[i].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine - sign * white[:, c]).max() < tolerance
        assert all(own[i].n == n and own[i].deviation == d for (i, _), d in zip(rows, dev, strict=True))
        assert all(abs(own[i].explained / explained[c] - 1) < 1e-9 and own[i].identity_error < 1e-9 for i, _ in rows)


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.geomspace(8, 0.5, d) @ np.linalg.qr(r.normal(size=(d, d)))[0]
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def frame(spark, rows, kind="float", parts=5):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as x", "2 as d", "'a' as n", "3 as `a.b`").repartition(parts)


@pytest.mark.parametrize("d,parts", [(3, 1), (24, 5), (24, 40)])
def test_against_covariance(spark, d, parts, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = vectors(300, d)
    rows += [(1000 + i, v) for i, v in rows[:50]]
    check(whiten(frame(spark, rows, parts=parts)).collect(), rows, most=min(16, d))


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whiten(df).collect(), rows, 1e-6)


def test_odd_rows(spark):
    rows = vectors(40, 4)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [nan] * 4), (103, [inf, 0.0, 0.0, 0.0]), (104, [1e300, 0.0, 0.0, 0.0]), (105, [])]
    own = [(200 + i, [float(i), float(i * i)]) for i in range(5)]  # another length
    got = whiten(frame(spark, rows + odd + own + [(None, rows[0][1])], "double")).collect()
    assert not {r.vec_id for r in got} & {100, 101, 102, 103, 104, 105}
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert {r.component: r.whitened for r in got if r.vec_id is None} == first
    check([r for r in got if r.vec_id is not None and r.vec_id < 100], rows, most=4)
    check([r for r in got if r.vec_id is not None and r.vec_id >= 200], own, most=2)


def test_no_variance(spark):
    got = whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert sorted(map(tuple, got)) == [(i, c, 1, 0, None, None, None) for i, c in ((1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2))]
    flat = whiten(frame(spark, [(i, [float(i), 0.0, float(2 * i)]) for i in range(9)])).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat if r.component > 1} == {(2, True, 0.0), (3, True, 0.0)}
    assert max(r.identity_error for r in flat) < 1e-12 and {round(r.explained, 9) for r in flat if r.component == 1} == {1.0}
    assert whiten(frame(spark, [])).collect() == []


def test_large_numbers(spark):
    """Entries that only exact sums keep apart; deviations that no long holds."""
    rows = [(i, [1e12 + i, float(i * i % 7), 3.0 * (i % 2)]) for i in range(50)]
    check(whiten(frame(spark, rows, "double")).collect(), rows, 1e-6, most=3)
    far = whiten(frame(spark, [(0, [1e15]), (1, [-1e15])], "double")).collect()
    assert [r.deviation for r in far] == [None, None]


def test_triangle():
    r = np.random.default_rng(3).normal(size=(50, 6))
    assert np.allclose(np.abs(triangle(np.vstack([triangle(r[:3]), triangle(r[3:])]))), np.abs(triangle(r)))
