import json

import pytest

from quarry.operators import access as A


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def policies(spark):
    principals = spark.createDataFrame([("ann", ["reader", "writer"]), ("bob", ["reader"]), ("eve", None), ("new", ["reader"]), (None, ["reader"])], "principal string, held array<string>")
    known = [("ann", ["reader", "writer"], ["/"], ["/notes/", "/drafts/"], [1]), ("bob", ["writer", "reader", "admin"], ["/"], ["/"], [1]), ("eve", [], ["/open/"], [], [1])]
    return A.resolved(principals, spark.createDataFrame(known, "principal string, roles array<string>, read_prefixes array<string>, write_prefixes array<string>, held array<int>"))


def test_policies(policies):
    assert rows(policies, "principal", "refused", "roles", "write_prefixes") == sorted(
        [
            ("ann", None, ["reader", "writer"], ["/notes/", "/drafts/"]),
            ("bob", "missing required roles: admin, writer", [], []),
            ("eve", None, [], []),
            ("new", "unknown principal", [], []),
            (None, "unknown principal", [], []),
        ],
        key=repr,
    )


def change(kind, path, new=None):
    return {"kind": kind, "path": path, "new_path": new}


CASES = [
    ("ann", json.dumps([change("create", "/notes/a.md"), change("rename", "/notes/a.md", "/drafts/b.md")]), 2, None),
    ("ann", json.dumps([change("rename", "/notes/a.md", "/else/b.md"), change("drop", "/notes/a.md")]), 2, "cannot write /else/b.md"),
    ("ann", json.dumps([change("patch", "/notes")]), 1, None),  # the folder itself
    ("ann", json.dumps([change("patch", "/notes2/a.md")]), 1, "cannot write /notes2/a.md"),
    ("ann", json.dumps([change("patch", "/Notes/a.md")]), 1, "cannot write /Notes/a.md"),
    ("ann", json.dumps([change("drop", "/notes/a.md")]), 1, "unsupported change kind: drop"),
    ("ann", json.dumps([change("patch", None)]), 1, "no path"),
    ("ann", json.dumps([change("rename", "/notes/a.md")]), 1, "no new path"),
    ("ann", json.dumps([change("patch", "/notes/a.md", "/else/b.md")]), 1, None),  # only a rename has a new path
    ("ann", "[]", 0, "no changes"),
    ("ann", "{", 0, "no changes"),
    ("ann", None, 0, "no changes"),
    ("bob", json.dumps([change("patch", "/notes/a.md")]), 1, "missing required roles: admin, writer"),
    ("eve", json.dumps([change("patch", "/open/a.md")]), 1, "lacks role: writer"),
    ("who", json.dumps([change("patch", "/notes/a.md")]), 1, "unknown principal"),
    (None, json.dumps([change("patch", "/notes/a.md")]), 1, "unknown principal"),
]


def test_changes(spark, policies):
    asked = spark.createDataFrame([(i, p, c, "x") for i, (p, c, _, _) in enumerate(CASES)], "proposal_id int, principal string, changes string, roles string")
    found = rows(A.authorised(A.normalised(asked).withColumn("roles", A.F.lit("clash")), policies, "writer"), "proposal_id", "changes", "allowed", "reason")
    assert found == sorted([(i, n, why is None, why) for i, (_, _, n, why) in enumerate(CASES)], key=repr)


def test_read_only(spark, policies):
    asked = spark.createDataFrame([(1, "ann", json.dumps([change("patch", "/else/a.md")]))], "proposal_id int, principal string, changes string")
    assert rows(A.authorised(A.normalised(asked), policies, "reader", ("read",)), "allowed") == [(True,)]
    assert A.authorised(A.normalised(asked.limit(0)), policies, "reader").count() == 0


def test_recovered(spark):
    ops = [(1, "a", 5, 9), (2, "a", 5, 5), (3, "a", 9, None), (4, "a", None, None), (5, "b", 3, None), (6, None, None, None), (7, "a", 9, 8)]
    heads = spark.createDataFrame([("a", 9), ("c", 1)], "repository string, head int")
    found = A.recovered(spark.createDataFrame(ops, "id int, repository string, base int, worktree int").withColumn("head", A.F.lit(0)), heads)
    assert rows(found, "id", "recovery") == [(1, "published"), (2, "conflict"), (3, "retryable"), (4, "retryable"), (5, "conflict"), (6, "retryable"), (7, "retryable")]


def test_versions(spark):
    versions = spark.createDataFrame([("p", f"1.{i}.0", 4 - i) for i in range(4)], "asset string, version string, rank int")
    wanted = spark.createDataFrame([("p", "1.0.0"), ("p", "1.0.0"), ("q", "1.1.0"), ("p", "9.9.9"), (None, None)], "asset string, version string")
    assert rows(A.pruned_versions(versions, 2, wanted), "version", "kept") == [("1.0.0", True), ("1.1.0", False), ("1.2.0", True), ("1.3.0", True)]
