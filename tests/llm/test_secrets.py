import hashlib
import random
import re
import string

import numpy as np
import pytest

from quarry.llm.secret_scan import ALPHABET, LEAST, PROGRAM_WORDS, estimates, samples, scan, secrets, train

KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def brute_assign(t):
    """A reading of the rule character by character, without a pattern."""
    out, i, low = [], 0, "".join(c.lower() if c in string.ascii_letters else c for c in t)
    while i < len(t):
        word = next((k for k in KEYWORDS if low.startswith(k, i)), None)
        end = None
        if word:
            j = i + len(word)
            j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
            while t[j : j + 1] == " ":
                j += 1
            if t[j : j + 1] in (":", "="):
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
                k = j
                while k < len(t) and t[k] in VALUE:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        out.append(("assign", i, k))
        i = end or i + 1
    return out


def brute_runs(t, kind, chars, least, head=""):
    out, i = [], 0
    while i < len(t):
        if t.startswith(head, i) and t[i + len(head) : i + len(head) + 1] in chars and i + len(head) < len(t):
            j = i + len(head)
            while j < len(t) and t[j] in chars:
                j += 1
            if j - i >= least:
                out.append((kind, i, j))
            i = j
        else:
            i += 1
    return out


def brute(t):
    t = t or ""
    out = brute_assign(t) + brute_runs(t, "access", set(string.ascii_uppercase + string.digits), 20, "AKIA") + brute_runs(t, "hex", set("0123456789abcdef"), 24)
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


@pytest.fixture(scope="module")
def models(spark, sf):
    return train(samples(spark.read.parquet(f"{sf}/documents.parquet")))


def test_base_rules(spark, models):
    r = random.Random(1)
    parts = ["token", "Secret", "PASSWD", "api_key", "ApiKey", "password", "toKen", "ſecret", "toKen", "=", ":", " = ", "  :", '"', "'", '="', "abcdef", "abc", "x.y/z", "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15, "0123456789abcdef", "deadbeef" * 3, "é", "日本", "\n", "\t", " ", "token:abc token=abcdefg", "secret:token = abcdefgh", "AKIAAKIA" + "B" * 14]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "x" * 200_000), (None, "token=abcdef"), (1, "token=abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as spans", "2 as `a.b`")
    got = scan(df, models).select("row.doc_id", "spans").collect()
    mine = [(d, [tuple(s) for s in spans if s.kind != "model"]) for d, spans in got]
    assert sorted(mine, key=repr) == sorted([(d, brute(t)) for d, t in rows], key=repr)
    for (d, spans), (e, t) in zip(got, rows, strict=True):
        own = [(a, b) for _, a, b in brute(t)]
        assert d == e
        for kind, a, b in spans:
            if kind == "model":
                assert b - a >= LEAST and set(t[a:b]) <= set(ALPHABET) and all(b <= x or y <= a for x, y in own)
    assert scan(df.where("false"), models).collect() == []


def test_held_out(models):
    """Strings that no sample drew, and names of words in new orders."""
    r = random.Random(2)
    alphabets = {"hex": "0123456789abcdef", "base 64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "capitals": string.ascii_uppercase + string.digits, "all": string.ascii_letters + string.digits}
    for name, a in alphabets.items():
        drawn = ["".join(r.choice(a) for _ in range(r.randrange(20, 41))) for _ in range(500)]
        assert sum(map(models.random, drawn)) >= 495, name
    words = lambda: r.sample(PROGRAM_WORDS, 4)
    ordinary = ["_".join(words()) for _ in range(300)] + ["-".join(words()) for _ in range(300)] + ["".join(x.title() for x in words()) for _ in range(300)] + ["/".join(words()) for _ in range(300)] + [str(r.randrange(10**15, 10**19)) for _ in range(300)]
    ordinary = [x for x in ordinary if len(x) >= LEAST]
    assert len(ordinary) > 1400 and sum(map(models.random, ordinary)) <= len(ordinary) / 200


def test_ordinary_names(models):
    fine = "application/x-www-form-urlencoded internationalization HttpServletRequestWrapper donaudampfschifffahrtsgesellschaft 4952935900253052 -------------------------------- ========================= aaaaaaaaaaaaaaaaaaaaaaaa ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert not any(map(models.random, fine.split()))


def test_finds_what_rules_miss(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    secret = "xK9fQ2mZv7Lw3RtB8nYd5HcJ"
    added = spark.createDataFrame([(10**6, f"the key is {secret} indeed"), (10**6 + 1, f"token={secret} {secret}")], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets(docs.union(added)).select("row.doc_id", "spans").collect()}
    assert got[10**6] == [("model", 11, 11 + len(secret))]
    assert got[10**6 + 1] == [("assign", 0, 6 + len(secret)), ("model", 7 + len(secret), 7 + 2 * len(secret))]


def test_estimates():
    n = np.zeros((len(ALPHABET) + 1,) * 3)
    n[0, 0, 1] = 3
    n[0, 1, 2] = 5
    p = estimates(n)
    assert p.shape == (len(ALPHABET) + 1, len(ALPHABET) + 1, len(ALPHABET)) and abs(p.sum(axis=2) - 1).max() < 1e-12
    assert p[0, 0, 0] > 0.5 and p[0, 1, 1] > 0.5 and (p > 0).all()


def test_query(spark, sf):
    from quarry.llm.queries import op11_secret_scan

    text = {d: t for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_secret_scan(spark, sf).collect()
    assert sorted(x.doc_id for x in got) == sorted(text)
    for x in got:
        own = brute(text[x.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == y for k, _, _ in own) for y in ("assign", "access", "hex"))
        assert [s for s in x.spans.split(",") if not re.match("model|$", s)] == [s for s in told.split(",") if s]
