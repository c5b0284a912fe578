"""Mixing: small sources, the permutation, the draws by shard, and texts that come back as they stand."""

import math
import random
from collections import Counter, defaultdict
from functools import reduce

from brute import words
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import mixing as M


def test_small_sources(spark):
    sizes = {"a": 1, "b": 10, "c": 64, "d": 65, "e": 100, "f": 3000, None: 7}
    rows = [(i, s, " ".join(f"{s}{j}" for j in range(n))) for i, (s, n) in enumerate(sizes.items())]
    rows += [(100 + i, "f", "x y") for i in range(40)]  # equal rows but for their ids
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as row", "'x' as spans", "2 as block", "3 as k")
    got = M.mix_sources(df).collect()
    taken, target = Counter(), {}
    source = {d: s for d, s, _ in rows}
    for x in got:
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
        assert 0 <= x.taken <= 2 * x.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, sizes[s] // M.FINEST + 1), (s, taken[s], target[s])
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_sources(df.repartition(3)).collect()))


def test_equal_rows(spark):
    rows = [(1, "a", "x y z")] * 50 + [(None, "a", "x y z")] * 3
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == 53 and sum(x.taken for x in got) == round(1.5 * 159 - 0.5) or abs(sum(x.taken for x in got) - 238.5) <= 1


def test_permutation(spark):
    found = {}
    for n in [1, 2, 3, 4, 5, 7, 16, 17, 63, 64, 65, 1000, 4099]:
        found[n] = spark.range(n).select(F.lit(n).alias("n"), "id", M.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(5)]).alias("y"))
    rows = reduce(DataFrame.union, found.values()).collect()
    for n in found:
        x = [r.y for r in sorted((r for r in rows if r.n == n), key=lambda r: r.id)]
        assert sorted(x) == list(range(n))
    steps = Counter((b - a) % n for a, b in zip(x, x[1:]))
    assert max(steps.values()) < 12  # no constant step, as an affine map has


def test_draws_by_shard(spark):
    """Counts of shards are those of independent draws: mean and variance of a multinomial, totals as asked."""
    slots = {1: 60000, 2: 30000, 3: 10000, 4: 1}
    rows = spark.createDataFrame([(i, n, n) for i, n in slots.items()], "id int, slots long, blocks long")
    found = defaultdict(dict)
    for x in M.counts_by_shard(rows, 500, 3).collect():
        found[x.id][x.k] = (x.start, x.stop)
    for i, n in slots.items():
        spans = sorted(found[i].values())
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for i in (1, 2, 3):
        p = slots[i] / 100001
        counts = [b - a for k, (a, b) in found[i].items() if k < 190]
        mean = sum(counts) / len(counts)
        var = sum((c - mean) ** 2 for c in counts) / len(counts)
        assert abs(mean - 500 * p) < 4 * math.sqrt(500 * p * (1 - p) / len(counts)) and 0.6 < var / (500 * p * (1 - p)) < 1.6


def test_documents_keep_line_feeds(spark):
    r = random.Random(4)
    rows = [(i, "abc"[i % 3], "".join(r.choice(["a", "bé", "c1", "-"]) + r.choice([" ", "\n", "\n\n  ", "\t"]) for _ in range(r.randrange(1, 300))).rstrip() if i % 7 else "\n x", 1) for i in range(60)]
    rows += [(100, None, None, 1), (101, "a", "", 1), (102, "b", " \n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").selectExpr("*", "1 as row", "'x' as spans", "2 as w", "3 as rest", "'y' as `a.b`")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    text = {d: t for d, _, t, _ in rows}
    taken = {x.doc_id: (x.taken, x.size) for x in M.mix_sources(df).collect()}
    for x in out.collect():
        n, size = taken[x.doc_id]
        assert len(words(x.text)) == n and x.n_chars == len(x.text) and x.rest == 3
        if n == size:
            assert x.text == text[x.doc_id] or set(words(x.text)) <= set(words(text[x.doc_id]))
        if n == 2 * size:
            assert x.text == text[x.doc_id] + "\n" + text[x.doc_id]
    assert {x for x, (n, _) in taken.items() if n} == {x.doc_id for x in out.collect()}


def test_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}", "en", f"s{i % 3}", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    from quarry.llm.mixing import mix_sources

    plan = mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2  # blocks that are drawn, and each document's sums
