import hashlib
import json
import random

from pyspark.sql import functions as F

from quarry.operators.nested import canonical, json_hash, strings_under
from quarry.operators.state import recent_activity

KEYS = ["path", "new_path"]


def walk(x, found):
    if isinstance(x, dict):
        for k, v in x.items():
            if k in KEYS and isinstance(v, str):
                found.add(v)
            walk(v, found)
    elif isinstance(x, list):
        for v in x:
            walk(v, found)
    return found


def drawn(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return rng.choice([None, True, 3, "", "/a.md", "/b.md", f"/{rng.randrange(50)}.md"])
    if kind == 4:
        return [drawn(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: drawn(rng, depth - 1) for k in rng.sample(["path", "new_path", "x", "é", "Path"], rng.randrange(5))}


def test_strings_under(spark):
    rng = random.Random(1)
    values = [{"path": drawn(rng, 6), "x": [drawn(rng, 6)]} for _ in range(150)] + ["path", 3, [], {}]
    deep = {"path": "/deep.md"}
    for i in range(40):
        deep = {"x": deep} if i % 2 else [deep]
    rows = [(i, json.dumps(v)) for i, v in enumerate([*values, deep])] + [(900, "{bad"), (901, None), (None, '{"path": "/n.md"}'), (902, ""), (903, '{"path":"/r.md"}'), (903, '{"new_path":"/q.md"}'), (904, json.dumps({"path": "x" * 100_000}))]
    df = spark.createDataFrame(rows, "id int, key string").withColumn("value", F.lit(1))
    found = {r.id: r.found for r in strings_under(df, "id", "key", KEYS).collect()}
    want = {i: sorted(walk(v, set())) for i, v in enumerate([*values, deep])}
    want |= {903: ["/q.md", "/r.md"], 904: ["x" * 100_000]}
    assert found == {i: v for i, v in want.items() if v}
    assert strings_under(df.limit(0), "id", "key", KEYS).count() == 0


def test_canonical(spark):
    rng = random.Random(2)
    values = [{"z": 1, "a": {"c": [1, {"y": None, "b": True}], "B": "ü \n"}, "": "x"}, *[drawn(rng, 5) for _ in range(60)]]
    rows = [(i, json.dumps(v, indent=1)) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (900, "{bad"), (901, None), (902, '{"a":1,"a":2}')], "id int, j string")
    found = {r.id: (r.c, r.h) for r in df.select("id", canonical(F.col("j")).alias("c"), json_hash(F.col("j")).alias("h")).collect()}
    for i, v in enumerate(values):
        text = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert found[i] == (text, hashlib.sha256(text.encode()).hexdigest())
    assert all(found[i] == (None, None) for i in (900, 901, 902))


def test_recent_activity(spark):
    concepts = spark.createDataFrame([("1", "/a.md"), ("2", "/b.md"), ("2", "/b.md"), (None, "/c.md"), ("4", None)], "id string, path string")
    changes = spark.createDataFrame([("/a.md", "changed"), ("/a.md", "added"), ("/c.md", "added"), ("/gone.md", "removed"), (None, "x")], "path string, change string")
    found = {r.path: r for r in recent_activity(concepts, changes, "r1", "r2").collect()}
    assert set(found) == {"/a.md", "/c.md"} and found["/a.md"].dedupe_key == "recent_activity|1|r2"
    assert found["/a.md"].evidence_hash == hashlib.sha256(b'{"path":"/a.md","repo_revision":"r2","since_revision":"r1"}').hexdigest()
