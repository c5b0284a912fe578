import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import words
from tokenizers import Tokenizer

from quarry.llm import chat, licenses
from quarry.llm.lm import lm_scores
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import Encoder, first_fit, pack_documents
from quarry.llm.quality import quality_rules

BPE = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as n", "2 as row", "3 as g", "4 as size", "5 as bucket", "'x' as id", "6 as chunk").repartition(3)


def odd(r):
    rows = [(i, " ".join(r.choice(["a", "bb", "é", "the"]) + str(r.randrange(9)) for _ in range(r.randrange(200))), r.choice(["en", None]), f"s{r.randrange(4)}") for i in range(200)]
    return rows + [(300, None, None, None), (301, "", "en", "s0"), (302, " \n", "de", "new"), (303, "x " * 20000, "en", "s1"), (303, "x " * 20000, "en", "s1"), (None, "a b", "en", "s1"), (304, "w" * 3000, "en", "s2")]


ODD = ["a  b", " a", "a ", "\n\nx", "x\n y", "don't 5x y  ", "a\r\nb", "<|endoftext|> a", "\x00\x01", "", "é\n", "\n", "a\n\nb", "it's 's", "a  b", "a b c", "x\t y", "ab_c d__e", "日本 語", "\U0001f600 ok"]


def test_encoder():
    plain, fast = Tokenizer.from_file(BPE), Encoder(BPE)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice([" ", "\n", "a", "B", "é", "'s", "9", ".", "\t", "word"]) for _ in range(30)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_first_fit():
    r = random.Random(1)
    lengths = sorted((r.randrange(1, 100) for _ in range(500)), reverse=True)
    bins, offsets = first_fit(np.array(lengths), 100)
    left = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        at = next((i for i, x in enumerate(left) if x >= n), len(left))
        if at == len(left):
            left.append(100)
        assert (b, o) == (at, 100 - left[at])
        left[at] -= n


@pytest.mark.parametrize("group", [8_000_000, 3000])
def test_packing(spark, group):
    rows = odd(random.Random(4))
    got = pack_documents(frame(spark, rows), BPE, group_tokens=group, ids=True).collect()
    plain = Tokenizer.from_file(BPE)
    want = defaultdict(int)
    for d, t, *_ in rows:
        want[d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.doc_tokens].append((p.start, tuple(p.ids)))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    for (d, ids), n in want.items():
        pieces = sorted(docs[d, len(ids)])
        assert len(pieces) % n == 0 and sum((x for _, x in pieces[::n]), ()) == ids
    assert sum(len(x) for x in docs.values()) == len(got)


def test_mixing(spark):
    r = random.Random(6)
    rows = odd(r) + [(1000 + i, "w " * r.randrange(1500), "en", "big") for i in range(300)]
    df = frame(spark, rows)
    got = mix_sources(df, block=16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df, block=16).collect()), key=repr)
    assert sorted((x.doc_id, x.size) for x in got if x.doc_id is not None) == sorted((d, len(words(t))) for d, t, *_ in rows if d is not None)
    source = {d: s for d, _, _, s in rows}
    sizes = defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, 1.5 * sum(sizes.values())
    free = set(order)
    while free:
        rate = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    taken = defaultdict(int)
    for x in got:
        assert x.source_size == sizes[source[x.doc_id]] and abs(x.target - target[source[x.doc_id]]) < 1e-6 * total
        assert 0 <= x.taken <= 2 * x.size
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 16 * 6 + 0.01 * target[s] for s in order)
    assert mix_sources(frame(spark, [])).collect() == []
    assert [x.taken for x in mix_sources(frame(spark, [(1, None, None, None)])).collect()] == [0]


def test_quality_rules(spark, sf):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(30, 300))), "en", f"s{i % 3}") for i in range(600)]
    junk = [(1000 + i, " ".join("word&&&" + str(r.randrange(999)) for _ in range(100)), "en", "s0") for i in range(20)]
    repeat = "one two three four five six seven eight nine ten "
    extra = [(2000, repeat * 9, "en", "s0"), (2001, "a b", "en", "s0"), (2002, "l1 x\nl1 x\n\n\nl1 x\n y", None, None), (2003, None, "en", "s1"), (2004, "", "zz", "s1"), (2004, "", "zz", "s1"), (None, "#" * 50, None, "s1"), (2005, "aa " * 40000, "en", "s2")]
    got = {x.doc_id: x for x in quality_rules(frame(spark, rows + junk + extra)).collect()}
    for d, t, *_ in rows + junk + extra:
        w, x = words(t), got[d]
        keys = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {k: keys.count(k) for k in set(keys)} if len(w) < 1000 else {k: len(keys) for k in set(keys)}
        covered = {j for i, k in enumerate(keys) if seen[k] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), d
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert all(got[d].kept for d, *_ in rows) and not any(got[d].kept for d, *_ in junk)
    assert not any(got[d].kept for d in (2000, 2001, 2003, 2004))
    assert quality_rules(frame(spark, [])).collect() == []


def test_escape():
    r = random.Random(9)
    for _ in range(2000):
        t = "".join(r.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "[", "\n", "x", " "]) for _ in range(r.randrange(9)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 30), (5, 0)])
def test_chat(spark, budget, history):
    r = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 60 if c == 7 else 8)):
            rows.append((c, t, "system" if t == 0 and c % 3 else r.choice(["user", "assistant", "tool\n\\n", None]), r.choice([None, "", "<s>[INST] ", "a\\", "hi there " * r.randrange(20)])))
    rows += [(None, 0, "user", "x"), (50, None, "user", "y"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as loss").repartition(3)
    windows = chat.chat_windows(df, BPE, budget, history)
    import hashlib

    want = {}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0, q or "", x or "") for d, t, q, x in rows if d == c))
        loss = "".join(x for _, _, q, x in turns if q == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), digest("".join(f"{q}\n{x}\n" for _, _, q, x in turns)), len(loss), digest(loss))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.read_back(windows).collect()}
    assert got == want
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    for w in windows.collect():
        turns = chat.TURN.findall(w.text)
        assert w.n_tokens <= budget or len(chat.TURN.findall(w.text[w.new_from :])) == 1 or w.window == 0
        assert w.n_tokens >= 0.9 * len(plain.encode(w.text, add_special_tokens=False).ids) and turns


def test_licenses(spark):
    r = random.Random(5)
    plain = [" ".join("".join(r.choice("aeioulnst") for _ in range(r.randrange(2, 8))) for _ in range(40)) + ".\nThe rest of the text and this line." for _ in range(300)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)]
    want = {}
    for i, (family, notices) in enumerate(licenses.NOTICES.items()):
        for j, t in enumerate(notices):
            d = 1000 + 10 * i + j
            rows.append((d, plain[i] + "\nSome words before. " * (j % 2) + "\n" + t.upper() * (j == 0) + t * (j > 0) + "\nmore", "en", "s"))
            want[d] = family
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (5002, "I permit it. The license of my dog was free, and the public works.", "en", "s"), (5003, "word " * 50000, "en", "s")]
    got = {x.doc_id: x.families for x in licenses.licenses_by_document(frame(spark, rows)).collect()}
    assert all(not got[d] for d, *_ in rows if d not in want)
    right = sum(got[d] == f for d, f in want.items())
    assert right >= 0.95 * len(want), [(d, f, got[d]) for d, f in want.items() if got[d] != f]


def test_license_classifier_held_out():
    plain = ["some plain words of a text that goes on", "the public has a right to free software", "version 2 of the plan was licensed"] * 30
    w, b = licenses.fit(licenses.examples(plain, 1))
    rows = licenses.examples(plain, 2)
    hit = 0
    for grams, label in rows:
        z = np.array(b) + sum((np.array(w[g]) for g in grams if g in w), np.zeros(len(b)))
        hit += int(z.argmax()) == label
    assert hit / len(rows) > 0.97


def test_lm(spark):
    rows = odd(random.Random(11))
    docs = [words(t) for _, t, *_ in rows]
    c = defaultdict(int)
    for w in docs:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                c[tuple(w[i : i + n])] += 1
    total = sum(map(len, docs))

    def s(g):
        if len(g) == 1:
            return np.log(c[g] / total)
        return np.log(c[g] / c[g[:-1]]) if c[g] >= 2 else np.log(0.4) + s(g[1:])

    want = sorted((-1 if d is None else d, len(w), round(sum(s(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w))), 3)) for (d, *_), w in zip(rows, docs, strict=True))
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, round(x.log_score, 3)) for x in lm_scores(frame(spark, rows)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=0.01)
    assert lm_scores(frame(spark, [])).collect() == []
