import sys
from pathlib import Path

import pytest
from brute import cut_repeats, words
from test_near import brute_near

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality(steps):
    a, b = rows(steps[0]), rows(steps[1])
    assert set(b) < set(a) and all(a[d] == t for d, t in b.items())
    assert all(len(words(t)) >= 20 for t in b.values())


def test_near(steps):
    a, b = rows(steps[1]), rows(steps[2])
    classes = brute_near(list(a.items()))
    assert set(b) == {d for d, c in classes.items() if d == c} and all(a[d] == t for d, t in b.items())


def test_suffixes(steps):
    a, b = rows(steps[2]), rows(steps[3])
    for d, n, gone, text in cut_repeats(list(a.items()), 50):
        assert b.get(d) == (a[d] if not gone else text if gone < n else None)


def test_mixing_and_packing(steps):
    a, b = rows(steps[3]), rows(steps[4])
    assert set(b) <= set(a)
    total = sum(len(words(t)) for t in a.values())
    assert abs(sum(len(words(t)) for t in b.values()) - 1.5 * total) < 0.05 * total
    assert all(set(words(t)) <= set(words(a[d])) for d, t in b.items())
    pieces = steps[5].collect()
    assert {p.doc_id for p in pieces} == set(b)
