import random
import re
from collections import Counter, defaultdict

import numpy as np

from vecloom.llm import mixing as M
from vecloom.llm import rules as R

from .helpers import docs, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


TEXTS = [None, "", " \t\n\r\x0b\x0c", "a b c a b c", "x x x x", "é ü z\xa0w", "l1 a\nl1 a\n\n\nl1 a\nl2", "#$ * <b>|&% 1", "a b c d a b c e", "w " * 20_000, "A\x1cB \x85 C", "one", "a b a b a"]


def test_statistics():
    for t in [*TEXTS, prose(random.Random(0), 300) * 2]:
        assert R.text_stats(t)[:5] == stats(t), t


def junk(rng, i):
    t = prose(rng, 80)
    return [t.upper().replace(" ", "!! "), " ".join(w + "***" for w in t.split()), " | ".join(t.split()[:60]), " ".join(w for w in t.split()[:12] for _ in range(8))][i % 4]


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(1)
    texts = [junk(rng, i) if i % 3 == 0 else prose(rng, 90) for i in range(300)]
    d = docs(spark, texts, clash=True)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)] + [(500, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rules = R.fit_rules(d, labels)
    assert rules
    got = {r.doc_id: r for r in R.judge(d, rules, ["doc_id"]).collect()}
    late = range(200, 300)
    assert all(got[i].kept for i in late if i % 3)
    assert sum(not got[i].kept for i in late if i % 3 == 0) >= 0.9 * sum(i % 3 == 0 for i in late)


def test_expression_is_the_list(spark):
    rules = [[("symbol_share", ">", 0.1)], [("repeat_share", ">", 0.5), ("word_length", "<=", 3.0)]]
    out = {r.doc_id: r for r in R.judge(docs(spark, TEXTS), rules, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        n, chars, symbols, lines, repeated = stats(t)
        want = 1 if symbols / max(chars, 1) > 0.1 else 2 if repeated / max(n, 1) > 0.5 and chars / max(n, 1) <= 3 else 0
        assert out[i].rule == want
        failed = n < 50 or 100 * repeated > 50 * n
        assert out[i].base_failed == failed and out[i].kept == (not failed and want == 0)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert R.fit_rules(docs(spark, TEXTS), none) == []
    assert R.judge(empty(spark), [], ["doc_id"]).count() == 0


def test_covering_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    y = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = R.learn_decision_list(x, y, np.arange(900))
    got = np.zeros(900, bool)
    for r in rules:
        got |= R._covers(x, r)
    assert (got == y).mean() > 0.97


# ---- mixing ----


def fill(sizes, weights, most):
    """Targets by raising all shares until each is at its bound, one source at a time."""
    goal, total, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        left = total - sum(goal.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            return goal | {s: left * weights[s] / w for s in open_}
        goal |= {s: most * sizes[s] for s in over}
        open_ -= over
    return goal


def run(spark, texts, sources, clash=False):
    d = docs(spark, texts, sources, clash).withColumn("size", M.word_count())
    return M.weighted_mix(d, M.cycled_weights(d, (1, 2, 3))).collect()


def test_mix(spark):
    rng = random.Random(2)
    sources = ["hot"] * 400 + [None if s == "z" else s for s in rng.choices(["a", "b", "é", "z", "tiny"], [9, 5, 5, 5, 1], k=300)]
    texts = [prose(rng, rng.randint(1, 60)) for _ in sources]
    rows = run(spark, texts, sources, clash=True)
    assert len(rows) == 700
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(texts[r.doc_id].split()) and r.taken % r.size == 0 and r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
    order = sorted((s for s in size if s is not None)) + [None]
    goal = fill(size, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
    for s in size:
        assert abs(taken[s] - goal[s]) <= 60 + 0.01 * goal[s]
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, run(spark, texts, sources, clash=True)), key=str)


def test_mix_edges(spark):
    assert run(spark, [], []) == []
    rows = run(spark, [None, "", "a b", (7, "c d"), (7, "c d")], ["x", "x", None, "y", "y"])
    assert len(rows) == 5 and all(r.taken == 0 for r in rows if r.size == 0)
    assert all(r.taken == 0 and r.target == 0 for r in run(spark, [None, ""], ["a", "b"]))


def test_mix_bound_by_three(spark):
    texts, sources = ["w " * 10] * 30 + ["w " * 10], ["a"] * 30 + ["b"]
    by = {r.source: r for r in run(spark, texts, sources)}
    assert by["b"].target == 30 and by["a"].target == 280 and by["b"].taken == 30


def test_mix_is_the_queue(spark):
    """What is taken is what a plain queue takes: copies in order of virtual time until the budget is used up."""
    rng = random.Random(4)
    sources = [rng.choice("aaaaab") for _ in range(60)] + [None] * 7
    texts = [prose(rng, rng.randint(1, 40)) for _ in sources]
    d = docs(spark, texts, sources).withColumn("size", M.word_count())
    rows = {r.doc_id: r for r in M.weighted_mix(d, M.cycled_weights(d, (1, 2, 3))).collect()}
    turn = {r.doc_id: r.turn for r in d.selectExpr("doc_id", "xxhash64(doc_id, 0, size) AS turn").collect()}
    copies = []
    for s in {r.source for r in rows.values()}:
        sent = 0
        for r in sorted((r for r in rows.values() if r.source == s), key=lambda r: turn[r.doc_id]):
            copies += [((sent + r.size / 2 + e * r.source_size) / r.target, r.doc_id) for e in range(3)]
            sent += r.size
    left, want = sum(r.size for r in rows.values()), defaultdict(int)
    for _, i in sorted(copies):
        if rows[i].size / 2 > left:
            break
        want[i] += rows[i].size
        left -= rows[i].size
    assert {i: r.taken for i, r in rows.items()} == {i: want[i] for i in rows}
