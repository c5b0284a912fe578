"""The minimum covariance determinant against NumPy, on groups with clustered outliers."""

import math

import numpy as np

from quarry.llm import quality as Q


def test_chi_squared():
    r = np.random.default_rng(1)
    for k in (1, 2, 5, 7):
        x = (r.normal(size=(200_000, k)) ** 2).sum(axis=1)
        for q in (0.3, 0.75, 0.975):
            assert abs((x <= Q.quantile(q, k)).mean() - q) < 0.005
    x = r.normal(size=(400_000, 5))
    near = x[(x * x).sum(axis=1) <= Q.quantile(0.75, 5)]
    assert abs(Q.consistency(0.75, 5) * near.var() - 1) < 0.01


def factor(mean, cov):
    c = np.zeros((5, 5))
    for j in range(5):
        for i in range(j, 5):
            rest = cov[i, j] - c[i, :j] @ c[j, :j]
            c[i, j] = math.sqrt(max(rest, 1.0)) if i == j else rest / c[j, j]
    return mean, c


def d2(u, est):
    return (np.linalg.solve(est[1], (u - est[0]).T) ** 2).sum(axis=0)


def nearest(u, est, support):
    d = d2(u, est)
    b = np.floor(np.log2(d + 1e-6) * Q.BINS)
    last = np.sort(b)[math.ceil(len(u) * support) - 1]
    return u[b <= last]


def estimated(u, scale=1.0):
    return factor(u.mean(axis=0), scale * np.cov(u.T, bias=True))


def plain_mcd(x):
    mid = lambda y: np.sort(y, axis=0)[math.ceil(len(y) / 2) - 1]
    u = (x - mid(x)) / np.array(list(Q.FLOORS.values()))
    d = np.maximum(1.0, 1.4826 * mid(np.abs(u)))
    z = u / d
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    sign = np.divide(z, size, out=np.zeros_like(z), where=size > 0)
    scaled = lambda y: np.cov(y.T, bias=True) * np.outer(d, d)
    ests = [estimated(u), factor(np.zeros(5), np.diag(d * d)), factor(np.zeros(5), scaled(np.tanh(z))), factor(np.zeros(5), scaled(sign))]
    for _ in range(Q.STEPS[0]):
        ests = [estimated(nearest(u, e, Q.SUPPORT)) for e in ests]
    est = min(ests, key=lambda e: np.log(np.diag(e[1])).sum())
    for _ in range(Q.STEPS[1]):
        est = estimated(nearest(u, est, Q.SUPPORT))
    inside = u[d2(u, est) / Q.consistency(Q.SUPPORT, 5) <= Q.quantile(0.975, 5)]
    return d2(u, estimated(inside, Q.consistency(0.975, 5)))


def test_clustered_outliers(spark):
    r = np.random.default_rng(7)
    mix = np.eye(5) + 0.4 * np.tril(r.normal(size=(5, 5)), -1)
    groups = []
    for g in range(6):
        spread = 3.0 if g < 3 else 0.01
        x = r.normal(size=(400, 5)) @ mix.T * np.array([1.0, 0.6, 0.3, 0.2, 0.2])
        x[:80] = np.array([4, 3, 2.5, 1.5, 1.5]) + spread * 0.1 * r.normal(size=(80, 5))  # a fifth, all alike
        x[:, 4] *= g % 3 != 2  # a statistic that is nought in the whole group
        groups.append(x)
    rows = [(g * 1000 + i, g, *map(float, v)) for g, x in enumerate(groups) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row long, g long, x1 double, x2 double, x3 double, x4 double, x5 double").repartition(3)
    got = {x.row: x.d2 for x in Q.robust_distances(df).collect()}
    cutoff = Q.quantile(Q.WITHIN, 5)
    for g, x in enumerate(groups):
        mine = np.array([got[g * 1000 + i] for i in range(400)])
        assert np.allclose(mine, plain_mcd(x), rtol=1e-6, atol=1e-6)
        assert (mine[:80] > cutoff).all() and (mine[80:] <= cutoff).mean() > 0.995
