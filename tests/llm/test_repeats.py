import random

import pytest
from brute import cut_repeats, key

from quarry.llm.substring_dedup import dedup_substrings
from quarry.llm.suffix_dedup import dedup_suffixes


def cases():
    r = random.Random(5)
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, " ".join(r.choice(["a", "b", "é", "the", "x y"]) + str(r.randrange(4)) for _ in range(r.randrange(120)))) for i in range(40)]
    rows += [(100 + i, f"p{i} q\n" + line + "\t\v end" * (i % 3)) for i in range(60)]
    rows += [(200, "z " * 3000), (201, None), (202, ""), (203, " \n\t "), (204, line), (204, line), (204, "other " + line), (None, line), (None, None), (205, "w" * 5000)]
    return rows


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(spark, window):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "'x' as blob", "2 as spans").repartition(3)
    got = dedup_substrings(df, window).collect()
    assert key(got) == key(cut_repeats(rows, window))


def test_substrings_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df).collect() == []


def test_substrings_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert key(dedup_substrings(df).collect()) == key(cut_repeats(rows, 20))


@pytest.mark.parametrize("passage,anchor,hot", [(20, 5, 4096), (20, 5, 2), (50, 12, 4096)])
def test_suffixes(spark, passage, anchor, hot):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as places").repartition(3)
    got = dedup_suffixes(df, passage, anchor, hot).collect()
    assert key(got) == key(cut_repeats(rows, passage))


def test_suffixes_empty(spark):
    assert dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_minimisers(spark, monkeypatch):
    from quarry.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1 / 50)
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert key(dedup_substrings(df, 20).collect()) == key(cut_repeats(rows, 20))


@pytest.mark.parametrize("words", [1, 40, 400])
def test_full_buckets(spark, monkeypatch, words):
    from quarry.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "FULL", 1)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", words)
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    full = substring_dedup.crowded(df, 20, 4, substring_dedup.NONE, 16)
    assert len(set(full.tolist())) == len(full) and (words > 1 or len(full) > 8)
    assert key(dedup_substrings(df, 20).collect()) == key(cut_repeats(rows, 20))


def test_words_of_one_hash():
    import numpy as np
    import pyarrow as pa

    from quarry.llm.suffix_dedup import numbered
    from quarry.llm.words import Words

    w = Words(pa.array(["ab cd ab abc é ab", "cd xx"]))
    names = "ab cd ab abc é ab cd xx".split()
    for h in (w.h, np.full(w.n, 7, np.uint64), w.h % np.uint64(2)):
        w.h = h
        n = numbered(w).tolist()
        assert [[a == b for b in names] for a in names] == [[a == b for b in n] for a in n]
