"""Queries: evidence, audit, revisions, indexes, secrets, versions and similar titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.text import entropy, namespace, normalised_question, question_profile, semver
from quarry.operators import evidence as E
from quarry.operators.nested import canonical, strings_under
from quarry.operators.state import patched, recent_activity, revision_diff, upsert
from quarry.operators.similar import equal_titles, similar_concepts, similar_titles
from quarry.plans.registry import CONCEPTS, PROPOSALS, registry
from quarry.sources import bundle as B
from quarry.sources import markdown as M
from quarry.sources.tables import concepts, proposals, table

QUERIES, ORACLES, query = registry()

# Questions that hold the profiles' phrases, beside those of the table.
QUESTIONS = ["What is the API key?", "What is current in my personal memory?", "What was used before migration?", "Which rack is Atlas connected to?", "What is in the work workspace?", "Show my token usage trend", "What is my passphrase?", "Who owns Atlas?"]
ASKED = "asked AS (SELECT text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]))"
NORMAL = r"n AS (SELECT q, lower(trim(regexp_replace(coalesce(q, ''), '\s+', ' ', 'g'))) AS t FROM asked)"


def asked(spark, sf_dir):
    own = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("q")).union(own)


def has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def member(words: list[str]) -> str:
    return "list_has_any(ws, [" + ", ".join(f"'{w}'" for w in words) + "])"


@query(ASKED, NORMAL, r"w AS (SELECT *, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS ws FROM n)",
       f"""SELECT q, {has(X.SECRET_PHRASES)} AS secret,
  CASE WHEN {has(X.HISTORICAL_PHRASES)} THEN 'historical' WHEN {member(X.CURRENT_TERMS)} THEN 'current' ELSE 'neutral' END AS temporal,
  {has(X.RELATIONAL_PHRASES)} AS relational,
  CASE WHEN {member(X.PERSONAL_TERMS)} THEN 'personal' WHEN {member(X.WORK_TERMS)} THEN 'work' ELSE '' END AS namespace,
  array_to_string(list_filter(ws, lambda w, i: NOT list_contains({X.STOP_WORDS}, w) AND list_position(ws, w) = i), ' ') AS terms FROM w""")  # fmt: skip
def question_profiles(spark, sf_dir):
    return asked(spark, sf_dir).select("q", question_profile(F.col("q")).alias("p")).select("q", "p.*")


@query(ASKED, NORMAL, "SELECT sha256(t) AS cache_key, count(*) AS n FROM n GROUP BY 1")
def question_keys(spark, sf_dir):
    return asked(spark, sf_dir).groupBy(F.sha2(normalised_question(F.col("q")), 256).alias("cache_key")).agg(F.count("*").alias("n"))


OK = "ok AS (SELECT * FROM concepts WHERE status NOT IN ('deprecated', 'tombstone') AND NOT list_has_any(tags, ['conflicting', 'historical', 'obsolete', 'stale', 'credential', 'credentials', 'secret', 'secrets']))"


@query(CONCEPTS, OK, "SELECT id, path FROM ok")
def evidence_filter(spark, sf_dir):
    return E.eligible(concepts(spark, sf_dir), "current").select("id", "path")


@query(CONCEPTS, OK, "SELECT id FROM ok WHERE id NOT IN (SELECT unnest(supersedes) FROM ok)")
def supersession(spark, sf_dir):
    return E.unsuperseded(E.eligible(concepts(spark, sf_dir), "current")).select("id")


@query(CONCEPTS, "SELECT id, (list_bool_or([starts_with(w, 'autho') OR w = 'author' FOR w IN ws])::INT + list_bool_or([w = 'with' FOR w IN ws])::INT) >= 2 AS supported FROM (SELECT id, regexp_extract_all(lower(body), '\\w+') AS ws FROM concepts) WHERE len(ws) > 0")
def evidence_support(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("body"), F.lit(r"\w+"), F.lit(0))
    return concepts(spark, sf_dir).select("id", words.alias("ws")).where(F.size("ws") > 0).select("id", E.text_matches(["author", "with"], F.col("ws")).alias("supported"))


@query(CONCEPTS, "r AS (SELECT id, body, row_number() OVER (ORDER BY id) AS rank FROM concepts WHERE type = 'project' ORDER BY id LIMIT 12), s AS (SELECT *, coalesce(sum(length(body)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)", "SELECT id, substr(body, 1, greatest(0, 6000 - before)::BIGINT) AS excerpt FROM s WHERE before < 6000 AND length(body) > 0")
def excerpt_budget(spark, sf_dir):
    top = concepts(spark, sf_dir).where("type = 'project'").orderBy("id").limit(12)
    return E.excerpts(top.select("id", F.col("id").alias("rank"), F.col("body").alias("text")), 6000).select("id", "excerpt")


@query(CONCEPTS, "SELECT c.path, 'duplicate_id' AS issue, c.title AS detail FROM concepts c JOIN (SELECT title, min(path) AS first FROM concepts WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1) f ON c.title = f.title AND c.path <> f.first UNION ALL SELECT DISTINCT path, 'broken_link', replace(path, '.md', '.txt') FROM concepts WHERE doc_id % 10 = 3")
def audit_issues(spark, sf_dir):
    c = concepts(spark, sf_dir)
    found = c.select("path", F.when(F.col("doc_id") % 10 == 3, F.replace("path", F.lit(".md"), F.lit(".txt"))).otherwise(F.col("path")).alias("target_path"))
    return M.audit(c.where("title is not null").select(F.col("title").alias("id"), "path"), found.join(c.select(F.col("path")), "path"))


@query(CONCEPTS, "a AS (SELECT path, content_hash FROM concepts WHERE doc_id % 11 <> 0), b AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE content_hash END AS content_hash FROM concepts WHERE doc_id % 7 <> 0)", "SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.content_hash IS DISTINCT FROM b.content_hash")
def revision_changes(spark, sf_dir):
    c = concepts(spark, sf_dir).select("doc_id", "path", "content_hash")
    after = c.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("content_hash")))
    return revision_diff(c.where("doc_id % 11 <> 0"), after)


@query(CONCEPTS, "SELECT id, CASE WHEN doc_id % 9 = 0 THEN 'renewed' ELSE status END AS status FROM concepts WHERE doc_id % 10 <> 1 OR doc_id % 9 = 0")
def incremental_upsert(spark, sf_dir):
    c = concepts(spark, sf_dir).select("doc_id", "id", "status")
    return upsert(c, c.where("doc_id % 9 = 0").withColumn("status", F.lit("renewed")), c.where("doc_id % 10 = 1")).select("id", "status")


@query(CONCEPTS, "SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'patched' ELSE title END AS title, status FROM concepts")
def patch_overlay(spark, sf_dir):
    c = concepts(spark, sf_dir).select("id", "title", "status", "doc_id")
    patch = c.where("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 4 == 0, "patched").alias("title"), F.lit(None).cast("string").alias("status"))
    return patched(c.drop("doc_id"), patch, "id", ["title", "status"])


@query(CONCEPTS, "p AS (SELECT DISTINCT '/' || array_to_string(list_append(parts[2:k], '')[1:], '/') AS directory, parts[k + 1] AS child FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS k FROM concepts))", "SELECT directory, count(*) AS n, min(child) AS first FROM p GROUP BY directory")
def directory_index(spark, sf_dir):
    return M.directory_index(concepts(spark, sf_dir))


@query(CONCEPTS, r"SELECT updated_s, path, '- [' || regexp_replace(coalesce(title, ''), '([\\\[\]()*_`#>|])', '\\\1', 'g') || '](' || path || ')' AS line FROM concepts ORDER BY updated_s DESC, path DESC LIMIT 100")
def mutation_log(spark, sf_dir):
    return M.log_lines(concepts(spark, sf_dir)).orderBy(F.desc("updated_s"), F.desc("path")).limit(100)


@query(CONCEPTS, "SELECT id, length(body)::INT AS size, len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '# ')))::INT AS sections FROM concepts WHERE length(body) >= 6000")
def oversized(spark, sf_dir):
    sections = F.size(F.filter(F.split("body", "\n"), lambda x: F.startswith(x, F.lit("# "))))
    return concepts(spark, sf_dir).select("id", F.length("body").alias("size"), sections.alias("sections")).where((F.col("size") >= 6000) | (F.col("sections") >= 6))


@query(CONCEPTS, "SELECT DISTINCT namespace FROM concepts")
def namespaces(spark, sf_dir):
    return concepts(spark, sf_dir).select(namespace(F.col("path")).alias("namespace")).distinct()


SHAPES = " OR ".join(f"regexp_matches(body, '(?i){p}')" for p in X.SECRETS)


@query(CONCEPTS, f"SELECT id FROM concepts WHERE {SHAPES} OR len(list_filter(regexp_extract_all(body, '[A-Za-z0-9+/=_-]{{32,}}'), lambda w: list_entropy(string_split(w, '')) >= 3.5)) > 0")
def secret_scan(spark, sf_dir):
    return concepts(spark, sf_dir).where(X.has_secret(F.col("body"))).select("id")


@query(CONCEPTS, r"SELECT id, sha256(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(body), ''))) AS embedding_text_hash FROM concepts")
def embedding_text(spark, sf_dir):
    return concepts(spark, sf_dir).select("id", F.sha2(X.embedding_text(F.col("title"), F.lit(None).cast("string"), F.col("body")), 256).alias("embedding_text_hash"))


@query(CONCEPTS, "SELECT namespace, type AS value, count(*) AS n FROM concepts GROUP BY namespace, type")
def namespace_histogram(spark, sf_dir):
    return concepts(spark, sf_dir).groupBy("namespace", F.col("type").alias("value")).agg(F.count("*").alias("n"))


@query(CONCEPTS, "SELECT id, round(list_entropy(string_split(title, '')), 6) AS bits FROM concepts WHERE title <> ''")
def character_entropy(spark, sf_dir):
    """Of all titles with a character."""
    return concepts(spark, sf_dir).where("title <> ''").select("id", F.round(entropy(F.col("title")), 6).alias("bits"))


VERSIONS = "v AS (SELECT p_brand AS pack, (p_partkey % 3) || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version FROM part), s AS (SELECT DISTINCT pack, version, [x::INT FOR x IN string_split(version, '.')] AS key FROM v)"


def versions(spark, sf_dir):
    v = F.concat_ws(".", *[(F.col("p_partkey") % n).cast("string") for n in (3, 10, 7)])
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), v.alias("version")).distinct().withColumn("key", semver(F.col("version"))).where("key is not null")


@query(VERSIONS, "SELECT pack, arg_max(version, key) AS latest, count(*) AS n FROM s GROUP BY pack")
def semver_latest(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("pack").agg(F.max_by("version", "key").alias("latest"), F.count("*").alias("n"))


@query(VERSIONS, "SELECT pack, version FROM s QUALIFY row_number() OVER (PARTITION BY pack ORDER BY key DESC) > 5")
def retention(spark, sf_dir):
    from quarry.operators.tables import newest

    rows = versions(spark, sf_dir)
    kept = newest(rows, 5, [F.desc("key")], ["pack"])
    return rows.join(kept, ["pack", "version"], "left_anti").select("pack", "version")


@query()
def near_duplicate_titles(spark, sf_dir):
    return similar_titles(concepts(spark, sf_dir))


@query(CONCEPTS, "SELECT id, min(id) OVER (PARTITION BY lower(title)) AS first FROM concepts WHERE status = 'active' AND title IS NOT NULL")
def equal_title_members(spark, sf_dir):
    return equal_titles(concepts(spark, sf_dir))


@query()
def near_duplicate_concepts(spark, sf_dir):
    """Titles, descriptions (the body's next line's worth of text) and tags together."""
    return similar_concepts(concepts(spark, sf_dir).withColumn("description", F.substring("body", 81, 100)))


@query()
def evidence_traversal(spark, sf_dir):
    """Evidence for all questions of the conversations and the fixed ones, over links between concepts that follow one another in a tag."""
    from quarry.operators.graph import tag_chain
    from quarry.operators.index import search_many
    from quarry.operators.traverse import MOST, traverse
    from quarry.plans.search import indexed

    questions = asked(spark, sf_dir).distinct().select(F.sha2(F.coalesce("q", F.lit("")), 256).alias("qid"), F.col("q").alias("text"))
    c = concepts(spark, sf_dir)
    links = tag_chain(c).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    return traverse(questions, search_many(indexed(spark, sf_dir), questions, MOST), c, links)


@query()
def markdown_links(spark, sf_dir):
    c = concepts(spark, sf_dir)
    page = F.concat("title", F.lit(" [next]("), "path", F.lit("#top) `[code](/no.md)` ![image](/no.png) [out](http://x.y)"))
    return M.links(c.select("id", page.alias("body")), "id")


LINKED = "linked AS (SELECT c.*, coalesce(p.path, c.path) AS up, coalesce(p.doc_id, c.doc_id) AS up_id FROM concepts c LEFT JOIN concepts p ON p.doc_id = c.doc_id - 1)"


@query(CONCEPTS, LINKED, "m AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '/archive' || path ELSE path END AS own, CASE WHEN up_id % 7 = 0 THEN '/archive' || up ELSE up END AS top FROM linked)",
       "SELECT id, own AS path, sha256('[own](' || own || '#top) ![up](' || top || ') `[code](' || up || ')` ' || body) AS body_hash, CASE WHEN doc_id % 7 = 0 OR up_id % 7 = 0 THEN 1800000000 ELSE updated_s END AS updated_s FROM m")
def rename_propagation(spark, sf_dir):
    """Every seventh concept moves; each concept links to itself and to the one before, which code quotes too."""
    c = concepts(spark, sf_dir).select("doc_id", "id", "path", "body", "updated_s")
    before = c.select((F.col("doc_id") + 1).alias("doc_id"), F.col("path").alias("up"))
    front = F.concat(F.lit("[own]("), "path", F.lit("#top) ![up]("), F.coalesce("up", "path"), F.lit(") `[code]("), F.coalesce("up", "path"), F.lit(")` "))
    linked = c.join(before, "doc_id", "left").withColumn("body", F.concat(front, "body")).drop("up")
    renames = c.where("doc_id % 7 = 0").select(F.col("path").alias("old"), F.concat(F.lit("/archive"), "path").alias("new"))
    moved = M.rename_all(linked, renames, {"updated_s": F.lit(1800000000)})
    return moved.select("id", "path", F.sha2("body", 256).alias("body_hash"), "updated_s")


# Faults put in files, by the remainder of the document's number, and the error that each is.
FAULTS = {1: ("status: ", "state: ", "unknown_key"), 2: ("title: ", "title ", "bad_line"), 3: ("type: ", "type: un", "type"), 4: ("schema_version: 1", "schema_version: 2", "schema_version"), 5: ("Z\nupdated_by", "\nupdated_by", "time")}
FAULT = "CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN '{e}'" for k, (_, _, e) in FAULTS.items()) + " END"
FILED = r"regexp_replace(regexp_replace(replace(body, chr(13) || chr(10), chr(10)), '[ \t\x0B\f\r]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')"


@query(CONCEPTS, rf"f AS (SELECT *, {FAULT} AS fault, CASE WHEN title IS NULL THEN 'missing_key' WHEN title = '' THEN 'empty' WHEN regexp_matches(title, '[\x00-\x1f\x7f]') THEN 'control' END AS own, {FILED} AS filed FROM concepts)",
       # of several rules that a file breaks the first in the order of the checks: lines and keys, missing, version, empty, type, control, time
       "g AS (SELECT *, CASE WHEN fault IN ('unknown_key', 'bad_line') THEN fault WHEN own = 'missing_key' THEN own WHEN fault = 'schema_version' THEN fault WHEN own = 'empty' THEN own WHEN fault = 'type' THEN fault WHEN own = 'control' THEN own ELSE fault END AS error FROM f)",
       "SELECT path, error, CASE WHEN error IS NULL THEN id END AS id, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN array_to_string(tags, ',') END AS tags, CASE WHEN error IS NULL THEN updated_s END AS updated_s, CASE WHEN error IS NULL THEN sha256(coalesce(filed, '')) END AS body_hash FROM g")
def bundle_round_trip(spark, sf_dir):
    """All concepts as files and back; a quarter of the files has a fault put in, and says which."""
    c = concepts(spark, sf_dir)
    none = F.array().cast("array<string>")
    moment = F.timestamp_seconds("updated_s")
    full = c.withColumns({"schema_version": F.lit(1), "description": F.col("title"), "aliases": none, "source_refs": none, "created_at": moment, "updated_at": moment, "updated_by": F.lit("someone/tablet")})
    text = F.col("value")
    for k, (old, new, _) in FAULTS.items():
        text = F.when(F.col("doc_id") % 20 == k, F.regexp_replace("value", rf"\A([\s\S]*?){old}", f"$1{new}")).otherwise(text)
    back = B.parsed(full.select("doc_id", "path", B.serialised().alias("value")).withColumn("value", text))
    return back.select("path", "error", "id", "title", F.array_join("tags", ",").alias("tags"), F.unix_seconds("updated_at").alias("updated_s"), F.sha2("body", 256).alias("body_hash"))


PATCHES = """patches AS (SELECT proposal_id, path, k, CASE WHEN proposal_id % 10 = 3 THEN '{' ELSE '' END || '{"changes":[{"path":"' || path || '","op":"rename","new_path":"/archive' || path || '"},[[{"meta":{"refs":[{"concept_path":"/k' || (k + 1) || '.md"},{"path":' || k || '}]}}]]],"props":' || props || '}' AS patch
  FROM proposals JOIN (SELECT event_id AS proposal_id, props, (props->>'$.k')::BIGINT AS k FROM events) USING (proposal_id))"""


def patches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("proposal_id"), "props", F.get_json_object("props", "$.k").cast("long").alias("k"))
    text = F.format_string('{"changes":[{"path":"%s","op":"rename","new_path":"/archive%s"},[[{"meta":{"refs":[{"concept_path":"/k%d.md"},{"path":%d}]}}]]],"props":%s}', "path", "path", F.col("k") + 1, "k", "props")
    broken = F.when(F.col("proposal_id") % 10 == 3, "{").otherwise("")
    return proposals(spark, sf_dir).join(e, "proposal_id").select("proposal_id", F.concat(broken, text).alias("patch"))


@query(PROPOSALS, PATCHES, "good AS (SELECT * FROM patches WHERE json_valid(patch))", "SELECT proposal_id, string_agg(DISTINCT value->>'$', ',' ORDER BY value->>'$') AS paths FROM good, json_tree(good.patch) WHERE key IN ('path', 'new_path', 'concept_path') AND type = 'VARCHAR' GROUP BY proposal_id")
def proposal_paths(spark, sf_dir):
    found = strings_under(patches(spark, sf_dir), "proposal_id", "patch", ["path", "new_path", "concept_path"])
    return found.select("proposal_id", F.array_join("found", ",").alias("paths"))


@query(PROPOSALS, PATCHES, """SELECT proposal_id, sha256('{"changes":[{"new_path":"/archive' || path || '","op":"rename","path":"' || path || '"},[[{"meta":{"refs":[{"concept_path":"/k' || (k + 1) || '.md"},{"path":' || k || '}]}}]]],"props":{"k":' || k || '}}') AS patch_hash FROM patches WHERE proposal_id % 10 <> 3""")
def patch_hashes(spark, sf_dir):
    """Hashes of the canonical form, so that equal patches written otherwise are equal."""
    return patches(spark, sf_dir).select("proposal_id", F.sha2(canonical(F.col("patch")), 256).alias("patch_hash")).where("patch_hash is not null")


@query(CONCEPTS, "SELECT 'recent_activity' AS signal_type, id, path, 'low' AS severity, 'recent_activity|' || id || '|r2' AS dedupe_key, sha256('{\"path\":\"' || path || '\",\"repo_revision\":\"r2\",\"since_revision\":\"r1\"}') AS evidence_hash FROM concepts WHERE (doc_id % 11 <> 0) <> (doc_id % 7 <> 0) OR (doc_id % 11 <> 0 AND doc_id % 13 = 0)")
def recent_activity_signals(spark, sf_dir):
    c = concepts(spark, sf_dir)
    return recent_activity(c, revision_changes(spark, sf_dir), "r1", "r2")
