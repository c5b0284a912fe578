"""Order statistics against sorted lists; numbering of large groups."""

import os
import random
from statistics import median as plain_median

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ranks as R
from quarry.operators.graph import nearest_rank, size_outliers, tag_chain
from quarry.operators.tables import numbered


@pytest.fixture(params=[2000, 5])
def fit(request, monkeypatch):
    monkeypatch.setattr(R, "FIT", request.param)
    monkeypatch.setattr(R, "CUTS", 64 if request.param > 5 else 4)


def values():
    r = random.Random(1)
    rows = [("hot", r.choice([r.random(), 7.0, 1e300 * r.random(), -(10 ** r.uniform(-300, 3))])) for _ in range(3000)]
    rows += [("one", 3.0), ("same", 5.0), ("same", 5.0), ("two", 1.0), ("two", 2.0), (None, 9.0), (None, 4.0), ("null", None), ("nan", float("nan")), ("nan", 2.0)]
    return rows


def test_quantiles(spark, fit):
    rows = values()
    df = spark.createDataFrame(rows, "k string, v double").selectExpr("*", "1 as g", "2 as x", "3 as t", "4 as rank").repartition(5)
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.fraction): (r.x, r.n) for r in R.quantiles(df, "v", fractions, "k").collect()}
    assert set(got) == {(k, f) for k in groups for f in fractions}
    for (k, f), (x, n) in got.items():
        assert n == len(groups[k]) and x == pytest.approx(float(np.quantile(groups[k], f)), rel=1e-12), (k, f)
    near = {(r.g, r.fraction): r.x for r in R.quantiles(df, "v", fractions, "k", nearest=True).collect()}
    for (k, f), x in near.items():
        assert x == sorted(groups[k])[round((len(groups[k]) - 1) * f)]
    assert {r.k: r.mid for r in R.median(df, "v", "k").collect()} == {k: pytest.approx(plain_median(v), rel=1e-12) for k, v in groups.items()}


def test_sketches_that_differ(spark, monkeypatch):
    # a sketch read twice isn't the same twice where its parts come from several executors
    monkeypatch.setattr(R, "FIT", 5)
    monkeypatch.setattr(R, "CUTS", 8)
    some = F.udf(lambda b: [x for x in b or [] if os.urandom(1)[0] % 2] or b, "array<double>")
    sketch = F.percentile_approx
    monkeypatch.setattr(R.F, "percentile_approx", lambda x, grid, n: some(sketch(x, grid, n)))
    r = random.Random(2)
    rows = [(f"k{i % 3}", float(r.randrange(10**6))) for i in range(1500)]
    got = {x.k: x.mid for x in R.median(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    assert got == {k: plain_median([v for g, v in rows if g == k]) for k in ("k0", "k1", "k2")}


def test_nearest_rank(spark, fit):
    for n in (1, 2, 3, 20, 333):
        df = spark.createDataFrame([(i * 7 % n,) for i in range(n)], "v long")
        assert nearest_rank(df, "v", 0.95).collect() == [(round((n - 1) * 0.95),)]
    assert nearest_rank(spark.createDataFrame([], "v long"), "v", 0.5).collect() == [(None,)]
    assert R.quantiles(spark.createDataFrame([], "v long"), "v", [0.5]).collect() == []


def test_size_outliers(spark):
    rows = [(f"i{i}", "/a/", "x" * (100 + i)) for i in range(9)] + [("big", "/a/", "x" * 5000), ("few", "/b/", "x" * 9000), ("none", "/a/", None), ("lost", None, "x" * 9000)]
    df = spark.createDataFrame(rows, "id string, namespace string, body string").selectExpr("*", "1 as mid", "2 as n", "3 as off", "4 as size")
    assert size_outliers(df).collect() == [("big", "/a/", 5000)]
    assert size_outliers(df.where("false")).collect() == []


def test_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", "c", None]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = sorted(map(tuple, numbered(df, ["g"], ["v"], "n").collect()), key=repr)
    seen, want = {}, []
    for g, v in sorted(rows, key=lambda x: x[1]):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, v, seen[g]))
    assert got == sorted(want, key=repr)
    assert sorted(x.n for x in numbered(df, [], ["v"], "n").collect()) == list(range(1, 4001))
    assert [x.v for x in numbered(df, [], ["v"], "n").orderBy("n").collect()] == list(range(4000))
    assert numbered(df.where("false"), ["g"], ["v"], "n").collect() == []


def test_tag_chain(spark):
    df = spark.createDataFrame([("c", ["s", "o"]), ("a", ["s"]), ("b", ["s", "o", "x"]), ("d", None), ("e", [])], "id string, tags array<string>").withColumn("n", F.lit(1))
    assert sorted(map(tuple, tag_chain(df).collect())) == [("o", "b", "c"), ("s", "a", "b"), ("s", "b", "c")]


def test_null_bodies_have_no_size(spark):
    rows = [(f"i{i}", "/a/", "x" * 5000) for i in range(4)] + [("big", "/a/", "x" * 9000)] + [(f"n{i}", "/a/", None) for i in range(9)]
    rows += [(f"f{i}", "/b/", "x") for i in range(2)] + [("far", "/b/", "x" * 9000), ("no", "/b/", None)]
    df = spark.createDataFrame(rows, "id string, namespace string, body string")
    assert size_outliers(df).collect() == [("big", "/a/", 9000)]
