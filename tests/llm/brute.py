"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def cut_repeats(docs, window):
    """docs: (doc_id, text). A list of (doc_id, n_words, n_removed, kept text)."""
    big = 1 << 63
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            at = (big if d is None else d, i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (big if d is None else d, i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)
