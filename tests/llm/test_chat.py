"""Chat windows one by one against a plain version, and edge cases."""

import random

import public_tokenizers

from quarry.llm import chat

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_windows(turns, budget, history):
    """(span, history) as lists of turn numbers; turns: (role, tokens)."""
    system = 1 if turns and turns[0][0] == "system" else 0
    fixed = turns[0][1] if system else 0
    at, out = system, []
    while at < len(turns):
        back = at
        while back > system and sum(n for _, n in turns[back - 1 : at]) <= min(history, budget - fixed - turns[at][1]):
            back -= 1
        to = at + 1
        while to < len(turns) and fixed + sum(n for _, n in turns[back : to + 1]) <= budget:
            to += 1
        out.append((list(range(at, to)), list(range(back, at))))
        at = to
    return out or ([([], [])] if system else [])


def test_windows():
    r = random.Random(5)
    for _ in range(400):
        budget, history = r.randrange(5, 60), r.randrange(0, 30)
        turns = [(r.choice(["system", "user", "assistant"]), r.randrange(1, 25)) for _ in range(r.randrange(12))]
        w, got = chat.Windows(budget, history), []
        for i, (role, n) in enumerate(turns):
            got += w.add(role, (f"<{i}>", 0, 0), n)
        got += w.close()
        system = turns and turns[0][0] == "system"
        for k, ((span, past), x) in enumerate(zip(plain_windows(turns, budget, history), got, strict=True)):
            assert x[1] == "".join(f"<{i}>" for i in ([0] if system else []) + past + span)
            assert x[0] == k and x[1][x[3] :] == "".join(f"<{i}>" for i in ([0] if system and not k else []) + span)


def test_empty_and_long(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], kinds), BPE)).collect() == []
    rows = [(1, 0, "user", "word " * 100_000), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 3, None, None), (2, 0, "system", "")]
    got = {x.conv_id: (x.n_turns, x.loss_chars) for x in chat.read_back(chat.chat_windows(spark.createDataFrame(rows, kinds), BPE)).collect()}
    assert got == {1: (3, 2), None: (1, 0), 2: (1, 0)}


def test_one_conversation_of_many_turns(spark):
    rows = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    x = chat.read_back(chat.chat_windows(rows, BPE, 200, 40)).collect()
    assert len(x) == 1 and x[0].n_turns == 20_000 and x[0].loss_chars == sum(len(f"t{i}") for i in range(1, 20_000, 2))
