"""Evidence of questions, one by one in plain loops."""

import random
import re
import time

from quarry.functions import text as X
from quarry.operators.traverse import eligible, profiled, traverse

CONCEPT = "id string, path string, title string, body string, status string, tags array<string>, supersedes array<string>"


def plain_profile(q):
    t = " ".join((q or "").split()).lower()
    w = re.findall(r"\w+", t)
    temporal = "historical" if any(p in t for p in X.HISTORICAL_PHRASES) else "current" if set(w) & set(X.CURRENT_TERMS) else "neutral"
    space = "personal" if set(w) & set(X.PERSONAL_TERMS) else "work" if set(w) & set(X.WORK_TERMS) else ""
    return temporal, any(p in t for p in X.RELATIONAL_PHRASES), space, [x for x in dict.fromkeys(w) if x not in X.STOP_WORDS]


def plain_evidence(q, ranked, concepts, links, most):
    temporal, relational, space, terms = plain_profile(q)

    def eligible(c):
        tags = {t.lower() for t in c["tags"] or []}
        if tags & set(X.SENSITIVE_TAGS) or space and not c["path"].startswith(f"/{space}/"):
            return False
        return not (temporal == "current" and (c["status"] in X.STALE_STATES or tags & set(X.STALE_TAGS)))

    def listed(n):
        own = [concepts[i] for i in ranked[:n] if eligible(concepts[i])]
        old = {x for c in own for x in c["supersedes"] or []}
        return [c for c in own if temporal == "historical" or c["id"] not in old]

    def matches(c):
        words = set(re.findall(r"\w+", f"{c['title'] or ''} {c['body'] or ''}".lower()))
        hits = sum(t in words or len(t) >= 5 and any(w.startswith(t[:5]) for w in words) for t in terms)
        return bool(terms) and hits >= min(2, len(terms))

    def timely(c):
        return c["status"] == "deprecated" or bool({"historical", "temporal"} & set(c["tags"] or [])) if temporal == "historical" else temporal != "current" or c["status"] == "active"

    five = listed(5)
    chosen = five if any(map(matches, five)) and any(map(timely, five)) else listed(10)
    reserve = min(2, max(0, most - 1)) if relational else 0
    primary = chosen[: max(1, most - reserve)]
    out = [(c["id"], "search", None) for c in primary]
    old = {x for c in primary for x in c["supersedes"] or []}
    for anchor in primary[:2] if relational else []:
        after = sorted({b for a, b in links if a == anchor["id"] and b and a != b}, key=lambda i: concepts[i]["path"])
        before = sorted({a for a, b in links if b == anchor["id"] and a != b}, key=lambda i: concepts[i]["path"])
        for i in after + before:
            if len(out) < most and i not in {x[0] for x in out} and eligible(concepts[i]) and (temporal == "historical" or i not in old):
                out.append((i, "graph", anchor["id"]))
    return out


def test_traverse(spark):
    r = random.Random(5)
    words = ["atlas", "rack", "host", "power", "memory", "token", "migration", "workspace", "owner"]
    concepts = {}
    for k in range(60):
        i = f"c{k:02}"
        tags = r.sample(["x", "y", "Secret", "stale", "historical", "temporal"], r.choice([0, 1, 1, 2]))
        concepts[i] = {"id": i, "path": f"/{r.choice(['personal', 'work', 'projects'])}/{i}.md", "title": r.choice([None, *words]), "body": r.choice([None, " ".join(r.choice(words) for _ in range(4))]), "status": r.choice(["active", "active", "deprecated", None]), "tags": r.choice([tags, tags, None]), "supersedes": r.choice([[], None, [f"c{r.randrange(60):02}"], [f"c{r.randrange(60):02}", "gone"]])}
    links = [(f"c{r.randrange(60):02}", r.choice([f"c{r.randrange(60):02}", None])) for _ in range(400)]
    texts = ["Which rack is Atlas connected to?", "Who owns the host memory now?", "What was the migration used to power?", "What is current in my personal memory token?", "In the work workspace, which host powers atlas", "atlas", "the", None, "", "history of what atlas depends on", "latest token"]
    questions = [(f"q{n:02}", r.choice(texts)) for n in range(80)] + [("lost", "atlas rack")]
    ranked = {q: r.sample(sorted(concepts), r.choice([0, 3, 7, 12])) for q, _ in questions[:-1]} | {"lost": []}
    rows = [(q, n, i) for q, own in ranked.items() for n, i in enumerate(own, 1)]
    frames = [spark.createDataFrame(questions, "qid string, text string"), spark.createDataFrame(rows, "qid string, rank int, id string").selectExpr("*", "1.0 as score", "'p' as path"), spark.createDataFrame([tuple(c.values()) for c in concepts.values()], CONCEPT).selectExpr("*", "1 as rank", "'q' as qid", "2 as terms", "'s' as space"), spark.createDataFrame(links, "source_id string, target_id string")]
    for most in (6, 2, 1):
        got = {}
        for x in traverse(*frames, most).orderBy("qid", "position").collect():
            assert x.path == concepts[x.id]["path"]
            got.setdefault(x.qid, []).append((x.id, x.source, x.anchor))
            assert x.position == len(got[x.qid])
        want = {q: plain_evidence(t, ranked[q], concepts, links, most) for q, t in questions}
        assert got == {q: e for q, e in want.items() if e}
        assert any(s == "graph" for e in got.values() for _, s, _ in e) == (most > 1)


def test_terms_of_long_texts(spark):
    # each term against each word of each candidate took minutes
    r = random.Random(6)
    texts = {f"c{k}": " ".join("".join(r.choice("abcdeé𝒳") for _ in range(r.randrange(1, 9))) for _ in range(n)) for k, n in enumerate((20000, 20000, 4, 0))}
    asked = [(f"q{n:03}", " ".join([r.choice(texts["c0"].split()), *("".join(r.choice("xyzw") for _ in range(r.randrange(1, 9))) + str(i) for i in range(60))][: r.choice([1, 2, 60])]), r.choice(list(texts))) for n in range(400)]
    asked += [("twin", "abcdef abcdeg", "t"), ("one", "abcdef zzz", "t"), ("short", "abcd", "t"), ("whole", "abcde", "t")]
    texts["t"] = "abcdeé0"
    ranked = spark.createDataFrame([(q, 1, i) for q, _, i in asked], "qid string, rank int, id string")
    concepts = spark.createDataFrame([(i, f"/x/{i}.md", None, t, "active", [], []) for i, t in texts.items()], CONCEPT)
    began = time.time()
    got = {x.qid: x.match for x in eligible(profiled(spark.createDataFrame([a[:2] for a in asked], "qid string, text string")), ranked, concepts).collect()}
    assert time.time() - began < 30
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items()}
    for q, t, i in asked:
        terms = plain_profile(t)[3]
        hits = sum(any(w.startswith(x[:5]) if len(x) >= 5 else w == x for w in words[i]) for x in terms)
        assert got[q] == (bool(terms) and hits >= min(2, len(terms))), (q, t)
    assert got["twin"] and not got["one"] and not got["short"] and got["whole"]
