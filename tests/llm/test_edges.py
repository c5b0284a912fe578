"""Odd rows through the pipeline's stages and the vector join."""

import random
import sys
from pathlib import Path

import numpy as np
from brute import words

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from quarry.llm.embedding_dedup import linked_vectors  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as row", "'x' as spans", "2 as w", "3 as _d", "4 as th", "5 as rest", "6 as g", "7 as v", "8 as node", "9 as `a.b`")


def test_stages_with_odd_rows(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) + r.choice(["", "\n"]) for _ in range(n))
    base = text(80)
    rows = [(i, text(r.randrange(20, 200)), r.choice(["en", None]), r.choice(["s0", "s1", None])) for i in range(120)]
    rows += [(200, base, "en", "s0"), (200, base, "en", "s0"), (None, base, "en", "s0"), (201, base + " more", "en", "s0"), (202, None, None, None), (203, "", "en", "s0"), (204, text(30_000), "en", "s1"), (None, text(90), "en", None)]
    for name, data in (("odd", [(*x, len(x[1] or "")) for x in rows]), ("none", [])):
        docs = odd_table(spark, data)
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert step == "packing" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
            if not data:
                assert docs.count() == 0
            elif step == "quality_rules":
                assert {202, 203}.isdisjoint({x.doc_id for x in docs.collect()})
            elif step == "near_dedup":
                left = [x.doc_id for x in docs.collect() if words(x.text)[:5] == words(base)[:5]]
                assert left == [200, 200]
        if data:
            assert docs.count() > 100


def test_double_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=8)
    rows = [(1, x.tolist()), (2, (x * (1 + 1e-12)).tolist()), (3, (-x).tolist()), (None, x.tolist()), (1, x.tolist())]
    got = sorted(map(repr, map(tuple, linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    assert got == sorted(map(repr, [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (3, 0, 3, True)]))
