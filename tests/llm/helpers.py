"""Fixtures and brute-force versions for the corpus operators."""

from __future__ import annotations

import random
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: As documents, with columns that clash with what operators add.
CLASHING = DOCS + ", size long, target double, taken string, spans int, score string, n_words string, component_id string, piece string, key string, range string, node string"


def docs(spark, texts, sources=None, clash=False):
    rows = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        s = sources[len(rows)] if sources else f"s{(i or 0) % 3}"
        rows.append((i, t, "en", s, None if t is None else len(t)) + ((1, 2.0, "x", 3, "y", "z", "c", "p", "k", "r", "n") if clash else ()))
    return spark.createDataFrame(rows, CLASHING if clash else DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


_RNG = random.Random(99)
VOCABULARY = ["".join(_RNG.choice("abcdefghijklmnoprstuvw") for _ in range(_RNG.randint(2, 9))) for _ in range(1500)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def words_of(text):
    return [w.decode("utf-8") for w in (text or "").encode().split()]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs that share a shingle."""
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    have = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            have[x].append(d)
    # shared shingles of every pair that shares any
    shared = defaultdict(int)
    for group in have.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                shared[a, b] += 1
    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}
