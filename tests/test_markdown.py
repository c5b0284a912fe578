import random

from pyspark.sql import functions as F

from quarry.sources import markdown as M

BODY = "See [b](/p/b.md#top) and `[no](/n.md)`."


def test_links(spark):
    docs = spark.createDataFrame([("/p/a.md", BODY), ("/p/c.md", None), ("/p/d.md", "")], "path string, body string")
    assert [(r.path, r.raw_target, r.target_path, r.anchor) for r in M.links(docs).collect()] == [("/p/a.md", "/p/b.md#top", "/p/b.md", "top")]


CONCEPTS = [
    ("/a.md", "to [b](/b.md#x), ![c](/c.md) `[b](/b.md)` [far](/b.mdx) [deep](/p/b.md) /b.md", 1, "x"),
    ("/b.md", "swap [a](/a.md)[c](/c.md)\n```\n[c](/c.md)\n```\n[`code`](/c.md)", 2, "x"),
    ("/c.md", None, 3, "x"), ("/d.md", "", 4, "x"), (None, "[b](/b.md) `open", 5, "x"), ("/e.md", "[d](/d.md) [gone](/gone.md)", 6, "x"),
]
RENAMES = [("/b.md", "/n/b.md"), ("/b.md", "/n/b.md"), ("/c.md", "/n/$1.md"), ("/a.md", "/e.md"), ("/gone.md", "/n/g.md"), ("/d.md", "/n/1.md"), ("/d.md", "/n/2.md"), ("/e.md", "/e.md"), (None, "/z.md"), ("/e.md", "/p/index.md")]


def test_rename_all(spark):
    concepts = spark.createDataFrame(CONCEPTS, "path string, body string, updated_s int, old string")
    renames = spark.createDataFrame(RENAMES, "old string, new string")
    issues = {(r.old, r.new): r.issue for r in M.judged_renames(concepts, renames).collect()}
    assert issues == {("/b.md", "/n/b.md"): None, ("/c.md", "/n/$1.md"): None, ("/a.md", "/e.md"): "taken", ("/gone.md", "/n/g.md"): "not_found", ("/d.md", "/n/1.md"): "ambiguous", ("/d.md", "/n/2.md"): "ambiguous", ("/e.md", "/e.md"): "bad_path", (None, "/z.md"): "bad_path", ("/e.md", "/p/index.md"): "bad_path"}
    clash = concepts.select("path", "body", "updated_s")
    found = {r.updated_s % 100: tuple(r) for r in M.rename_all(clash, renames, {"updated_s": F.col("updated_s") + 100}).collect()}
    assert found == {
        1: ("/a.md", "to [b](/n/b.md#x), ![c](/n/$1.md) `[b](/b.md)` [far](/b.mdx) [deep](/p/b.md) /b.md", 101),
        2: ("/n/b.md", "swap [a](/a.md)[c](/n/$1.md)\n```\n[c](/c.md)\n```\n[`code`](/n/$1.md)", 102),
        3: ("/n/$1.md", None, 103), 4: ("/d.md", "", 4), 5: (None, "[b](/b.md) `open", 5), 6: ("/e.md", "[d](/d.md) [gone](/gone.md)", 6),
    }


def test_rename_many(spark):
    """Random links against a plain loop; moves are made at once, so none is made twice."""
    rng = random.Random(3)
    paths = [f"/p{i}.md" for i in range(60)]
    texts = [" ".join(f"[t]({rng.choice(paths)}{rng.choice(['', '#s'])})" if rng.random() < 0.5 else "word" for _ in range(rng.randrange(30))) for _ in paths]
    moves = {p: f"/moved{p}" for p in rng.sample(paths, 25)}
    docs = spark.createDataFrame(list(zip(paths, texts)), "path string, body string").repartition(5)
    found = dict(map(tuple, M.rename_all(docs, spark.createDataFrame(list(moves.items()), "old string, new string"), {}).collect()))
    for path, text in zip(paths, texts):
        for old, new in moves.items():
            text = text.replace(f"]({old})", f"]({new})").replace(f"]({old}#", f"]({new}#")
        assert found[moves.get(path, path)] == text
    assert M.rename_all(docs, spark.createDataFrame([], "old string, new string"), {}).exceptAll(docs).isEmpty()
