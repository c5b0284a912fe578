import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import embeddings as E

CONCEPTS = "id string, path string, text string, status string, _id int"


def models():
    """Functions made here, so that they travel to workers whole."""

    def lengths(texts):
        if "bad" in texts:
            raise ValueError("bad " + "x" * 2000)
        return [{"short": [1.0], "empty": [0.0, 0.0], "odd": [float("nan"), 1.0], "none": None}.get(t, [float(len(t)), 1.0]) for t in texts]

    def refuses(texts):
        raise AssertionError("nothing was to be embedded")

    def miscounts(texts):
        return [] if len(texts) > 1 else [[1.0, 2.0]]

    return lengths, refuses, miscounts


lengths, refuses, miscounts = models()
MODEL = E.Model("m", 2, "1", lengths)
HASH = lambda t: hashlib.sha256(t.encode()).hexdigest()


def concepts(spark, texts, folder="/a/"):
    return spark.createDataFrame([(i, f"{folder}{i}.md", t, "clash", 7) for i, t in texts.items()], CONCEPTS)


def nothing(spark):
    return spark.createDataFrame([], E.STORED)


def by_id(df):
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert len(rows) == df.count()
    return rows


TEXTS = {"a": "one", "b": "bad", "c": "three", "d": None, "e": "", "f": "short", "g": "empty", "h": "odd", "i": "none", "j": "x" * 100_000, "k": "one"}


@pytest.mark.parametrize("batch", [1, 4, 100])
def test_rows(spark, batch):
    found = by_id(E.refresh(concepts(spark, TEXTS), nothing(spark), MODEL, "r1", batch))
    assert found.keys() == TEXTS.keys()
    for i, text in TEXTS.items():
        row = found[i]
        assert row["text_hash"] == HASH(text or "") and row["path"] == f"/a/{i}.md" and row["revision"] == "r1"
        good = text not in ("bad", "short", "empty", "odd", "none")
        assert row["status"] == ("ready" if good else "degraded")
        assert (row["vector"], row["error"] is None) == (([float(len(text or "")), 1.0], True) if good else (None, False))
        assert row["norm"] == (pytest.approx((len(text or "") ** 2 + 1) ** 0.5) if good else None)
    assert found["b"]["error"] == ("bad " + "x" * 2000)[: E.ERROR_CHARS]
    assert found["f"]["error"] == "1 dimensions where the model has 2" and found["i"]["error"].startswith("0 dimensions")


def test_fresh_rows_stay(spark):
    first = E.refresh(concepts(spark, {"a": "one", "b": "two"}), nothing(spark), MODEL, "r1")
    again = by_id(E.refresh(concepts(spark, {"a": "one"}, "/moved/"), first.withColumn("_id", F.lit(1)), E.Model("m", 2, "1", refuses), "r2"))
    assert again.keys() == {"a"}  # b is no more
    assert again["a"]["path"] == "/moved/a.md" and again["a"]["revision"] == "r2" and again["a"]["vector"] == [3.0, 1.0]


def test_changes_failures_and_other_models(spark):
    first = E.refresh(concepts(spark, {"a": "one", "b": "bad", "c": "two"}), nothing(spark), MODEL, "r1")
    second = by_id(E.refresh(concepts(spark, {"a": "longer", "b": "mended", "c": "two"}), first, MODEL, "r2"))
    assert [second[i]["vector"] for i in "abc"] == [[6.0, 1.0], [6.0, 1.0], [3.0, 1.0]] and second["b"]["error"] is None
    other = E.Model("m", 2, "2", miscounts)
    assert {r["status"] for r in E.model_stale(first, other).collect()} == {"stale"}
    assert {r["status"] for r in E.model_stale(first, MODEL).collect()} == {"ready", "degraded"}
    third = by_id(E.refresh(concepts(spark, {"a": "one", "b": "bad", "c": "two"}), first, other, "r2"))
    assert {(r["status"], tuple(r["vector"]), r["model_revision"]) for r in third.values()} == {("ready", (1.0, 2.0), "2")}


def test_only_some_paths(spark):
    first = E.refresh(concepts(spark, {"a": "one", "b": "two", "c": "three"}), nothing(spark), MODEL, "r1")
    only = spark.createDataFrame([("/a/a.md",), ("/a/a.md",), ("/none.md",), (None,)], "path string")
    found = by_id(E.refresh(concepts(spark, {"a": "newer", "b": "newer", "c": "three", "d": "new"}), first, MODEL, "r2", only=only))
    assert {i: (r["status"], r["revision"], r["vector"][0]) for i, r in found.items()} == {"a": ("ready", "r2", 5.0), "b": ("stale", "r1", 3.0), "c": ("ready", "r2", 5.0)}


def test_state(spark):
    c = concepts(spark, {"a": "one", "b": "bad"})
    assert E.embedding_state(c, E.refresh(c, nothing(spark), MODEL, "r1"), "r1").first().asDict() == {"concepts": 2, "ready": 1, "state": "partial"}
    assert E.embedding_state(c, nothing(spark), "r1").first()["state"] == ""
    assert E.embedding_state(c.where("id = 'a'"), E.refresh(c, nothing(spark), MODEL, "r1"), "r1").first()["state"] == "r1"
    assert E.refresh(c.limit(0), nothing(spark), MODEL, "r1").count() == 0


def test_names():
    with pytest.raises(ValueError):
        E.Model(" ", 2, "1", lengths)
    with pytest.raises(ValueError):
        E.Model("m", 0, "1", lengths)
