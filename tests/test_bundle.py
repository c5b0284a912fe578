import pytest
from pyspark.sql import functions as F

from quarry.sources import bundle as B

GOOD = """---
schema_version: 1
id: a
type: concept
title: "A: \\"title\\" ü"
status: active
description: 'it''s'
tags:
  - y
  - x
  - x
aliases: [b, 'c, d']
created_at: 2026-01-02T03:04:05Z
updated_at: 2026-01-02T05:04:05+02:00  # a comment
updated_by: rui/tablet
---


# Head  \r
text --- more\t
---
end

"""


def changed(old, new):
    assert old in GOOD
    return GOOD.replace(old, new)


BROKEN = [
    ("no_frontmatter", ""), ("no_frontmatter", None), ("no_frontmatter", "# only a body\n"), ("no_frontmatter", "---\nid: a\n"),
    ("bad_line", changed("status: active", "status active")), ("bad_line", changed("status: active", "- active")),
    ("repeated_key", changed("status: active", "id: b")), ("unknown_key", changed("status: active", "colour: red")),
    ("missing_key", changed("id: a\n", "")), ("missing_key", changed("updated_by: rui/tablet\n", "")),
    ("quotes", changed("'it''s'", "'it''s")), ("list", changed("[b, 'c, d']", "b")), ("schema_version", changed("schema_version: 1", "schema_version: 2")),
    ("empty", changed("id: a", "id: \"\"")), ("missing_key", changed("id: a", "id:")), ("repeated_key", changed("tags:\n", "title:\n")), ("list", changed("description: 'it''s'", "description:\n- x")), ("type", changed("type: concept", "type: thing")), ("status", changed("status: active", "status: gone")),
    ("control", changed("rui/tablet", '"rui\\ntablet"')), ("time", changed("03:04:05Z", "03:04:05")), ("time", changed("2026-01-02T03", "2026-13-02T03")),
]


def test_good(spark):
    row = B.parsed(spark.createDataFrame([("/p/a.md", GOOD, 1)], "path string, value string, title int")).first()
    assert row.error is None and row.raw is None
    assert (row.schema_version, row.id, row.type, row.title, row.status, row.description) == (1, "a", "concept", 'A: "title" ü', "active", "it's")
    assert (row.tags, row.aliases, row.supersedes) == (["x", "y"], ["b", "c, d"], [])
    assert row.created_at == row.updated_at and row.updated_by == "rui/tablet"
    assert row.body == "# Head\ntext --- more\n---\nend"


def test_errors(spark):
    rows = [(f"/{i:02}.md", text) for i, (_, text) in enumerate(BROKEN)]
    found = B.parsed(spark.createDataFrame(rows, "path string, value string")).orderBy("path").collect()
    assert [r.error for r in found] == [e for e, _ in BROKEN]
    assert [r.raw for r in found] == [t for _, t in BROKEN] and all(r.id is None and r.body is None for r in found)


ODD = ["a", "true", "No", "12", "1.5", "2026-01-02", "- a", "a: b", "a #b", "'q'", '"q"', "ü (x)", " lead", "trail ", "~", "null", "[x]", "{y}", "a\\b", "&a", "*b", "!c", "|", ">", "%d", "@e", "`f`", "?", "é\U0001f600", ".5", "/a/b.md", "a, b", "tab\tin", "line\nfeed"]


def test_scalars_round_trip(spark):
    """Each odd text as description, alias and (without control characters) title."""
    rows = [(f"/p/{i}.md", f"i{i}", x if x.isprintable() else "t", x, [x, "z"], f"\n\nbody {x.strip()}\n\n") for i, x in enumerate(ODD)]
    df = spark.createDataFrame(rows, "path string, id string, title string, description string, aliases array<string>, body string")
    none = F.array().cast("array<string>")
    full = df.select("*", F.lit(1).alias("schema_version"), F.lit("concept").alias("type"), F.lit("active").alias("status"), none.alias("tags"), none.alias("source_refs"), none.alias("supersedes"), F.timestamp_seconds(F.lit(1767323045)).alias("created_at"), F.timestamp_seconds(F.lit(1767323046)).alias("updated_at"), F.lit("me").alias("updated_by"))
    back = {r.id: r for r in B.parsed(full.select("path", B.serialised().alias("value"))).collect() if r.error is None}
    assert len(back) == len(ODD)
    for _, ident, title, text, aliases, body in rows:
        r = back[ident]
        assert (r.title, r.description, r.aliases, r.body) == (title, text, sorted(aliases), body.strip("\n"))
        assert (r.created_at.timestamp(), r.updated_at.timestamp()) == (1767323045, 1767323046)


def test_other_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        docs = B.parsed(spark.createDataFrame([("/p/a.md", GOOD)], "path string, value string"))
        assert "created_at: 2026-01-02T03:04:05Z\n" in docs.select(B.serialised().alias("s")).first().s
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_files(spark, tmp_path):
    source, target = tmp_path / "a b+c", tmp_path / "out"
    (source / "p").mkdir(parents=True)
    (source / "p" / "a%20ü.md").write_text(GOOD)
    (source / "p" / "bad.md").write_text("nothing")
    (source / "index.md").write_text("generated")
    docs = B.read_bundle(spark, str(source))
    assert {(r.path, r.error) for r in docs.collect()} == {("/p/a%20ü.md", None), ("/p/bad.md", "no_frontmatter")}
    with pytest.raises(Exception, match="no_frontmatter: /p/bad.md"):
        B.read_bundle(spark, str(source), failfast=True).collect()
    good = docs.where("error is null")
    for _ in range(2):  # again: files are replaced
        B.write_bundle(good, str(target))
        back = B.read_bundle(spark, str(target))
        assert back.count() == 1 and back.exceptAll(good).isEmpty() and good.exceptAll(back).isEmpty()
    assert [p.name for p in target.rglob("*") if p.is_file()] == ["a%20ü.md"]
    assert B.read_bundle(spark, str(target)).limit(0).count() == 0


@pytest.mark.parametrize(("path", "error"), [("/../x.md", "path"), ("/p/index.md", "path"), ("/p/x.txt", "path"), ("p/x.md", "path"), (None, "path")])
def test_paths_refused(spark, tmp_path, path, error):
    docs = B.parsed(spark.createDataFrame([("/p/a.md", GOOD)], "path string, value string"))
    with pytest.raises(ValueError, match=f": {error}$"):
        B.write_bundle(docs.withColumn("path", F.lit(path).cast("string")), str(tmp_path / "o"))
    with pytest.raises(ValueError, match="repeated_path$"):
        B.write_bundle(docs.union(docs), str(tmp_path / "o"))
    with pytest.raises(ValueError, match="type$"):
        B.write_bundle(docs.withColumn("type", F.lit("thing")), str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()


def test_query_and_sql_agree_on_odd_texts(spark, tmp_path):
    """Files that break two rules, and blanks that Java and Python see otherwise."""
    import duckdb

    from quarry.catalog import ORACLES, QUERIES

    odd = [None, "", ".x", "two\nlines. x", "ends in a no-break space\u00a0. x", "a \rb \u2028c \x0b\nd\t. x", "plain. x"]
    rows = [(20 * j + i, t, "en", "s", 1) for j, t in enumerate(odd) for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = QUERIES["bundle_round_trip"](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['bundle_round_trip']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
