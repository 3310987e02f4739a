import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import ngram_join as N
from vecloom.llm.common import spread_join

from .helpers import components, docs, empty, prose, shingles


def near(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.random())
    return " ".join(w)


def result(spark, df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1), min_size=2, max_size=25, unique=True), st.integers(0, 10))
def test_trie_finds_exactly_the_linked_pairs(raw, cut):
    sets = [np.array(sorted(s), np.uint64) for s in raw]
    rows = list(range(len(sets)))
    stored, probes = rows[:max(1, len(rows) - cut)], rows[cut % len(rows):]
    want = {(a, b) for a in stored for b in probes if 100 * len(raw[a] & raw[b]) >= 75 * len(raw[a] | raw[b])}
    assert set(N.trie_links(sets, stored, probes)) == want


def test_prefix_length_is_enough():
    for n in range(1, 200):
        assert N.prefix_length(n) == n - -(-3 * n // 4) + 1


def test_against_all_pairs(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(8)]
    texts = [near(rng, b, rng.randint(0, 6)) for b in base for _ in range(9)]
    texts += ["a b c", "A  B\tc", "a b", "x", "", None, " \n ", base[0] + " " + base[1], base[0].upper()]
    rng.shuffle(texts)
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))


def test_chain_and_common_passage(spark):
    """A chain links its ends over the middle; a passage in every document links nothing."""
    rng = random.Random(2)
    passage = prose(rng, 60)
    chain = [prose(rng, 80)]
    for _ in range(12):
        chain.append(near(rng, chain[-1], 2))
    texts = chain + [prose(rng, 120) + " " + passage + " " + prose(rng, 100) for _ in range(60)]
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))


def test_large_group_of_near_copies(spark):
    """More copies than a block holds, of which many pairs aren't similar."""
    rng = random.Random(3)
    base = prose(rng, 90)
    texts = [near(rng, base, rng.randint(0, 4)) for _ in range(600)]
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))


def test_edges(spark):
    assert result(spark, empty(spark)) == {}
    got = result(spark, docs(spark, [None, "", "same words here", "same words here"], clash=True))
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2)}
    twice = N.near_duplicates(docs(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(5, 5), (5, 5), (7, 5)]
    long = prose(random.Random(4), 30_000)
    assert result(spark, docs(spark, [long, long + " end"]))[1][1] == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(None, a), (None, near(rng, a, 1)), (None, b), (3, near(rng, b, 1)), (5, c), (5, d), (6, near(rng, d, 1)), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.component_id) for r in N.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (None, 3), (3, 3), (5, 5), (5, 5), (6, 5), (None, None), (None, None)], key=str)


def test_common_template_costs_no_pairs(spark, monkeypatch):
    """Documents of Jaccard 0.65 to each other: none links, and none meets another where components meet."""
    rng = random.Random(8)
    template = prose(rng, 120)
    texts = [template + " " + prose(rng, 32) for _ in range(800)]
    seen = {}
    keep = N.Scratch.cut

    def cut(self, df):
        out = keep(self, df)
        if set(df.columns) == {"sid", "token", "n", "hi", "label"}:
            seen["open"] = out.count()
        return out

    monkeypatch.setattr(N.Scratch, "cut", cut)
    got = result(spark, docs(spark, texts))
    assert all(got[i][1] == i for i in got) and seen["open"] <= len(texts)


def test_equal_halves_of_digests_are_told_apart(spark, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(6)]
    texts += [texts[0] + " more", texts[3] + " more"]
    whole = N.set_ids
    assert N.set_id(N.shingle_set(texts[0]), {}) == whole(N.shingle_set(texts[0]))[0]
    s = [N.shingle_set(t) for t in texts[:2]]
    clash = {whole(s[0])[0]: whole(s[1])[1]}
    assert N.set_id(s[0], clash) == whole(s[0])[1]
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))


def test_sets_of_common_shingles_make_no_pairs(spark, monkeypatch):
    """Documents of 24 of the same 30 sentences share most of their first shingles and don't link: few pairs are looked at, and those that link are found."""
    rng = random.Random(12)
    sentences = [prose(rng, 15) for _ in range(30)]
    texts = [" ".join(sentences[i] for i in sorted(rng.sample(range(30), 24))) for _ in range(300)]
    texts += [t + " " + prose(rng, 3) for t in texts[:20]]
    seen = []
    keep = N.Scratch.cut

    def cut(self, df):
        out = keep(self, df)
        if df.columns == ["g", "sid", "n"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(N.Scratch, "cut", cut)
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))
    assert max(seen) <= 10 * len(texts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(400, 800), st.integers(0, 120), st.integers(0, 120))
def test_bitmaps_rule_no_link_out(seed, n, less, more):
    """Of different widths too, and in blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    s = np.unique(rng.integers(0, 1 << 62, n + more, np.uint64))
    rng.shuffle(s)
    sets = [np.sort(s[:n]), np.sort(s[less:]), np.sort(s[:n // 2])]
    t = pa.table({"sid": [1, 2, 3], "n": [len(x) for x in sets], "hi": [10**6] * 3, "label": [1, 2, 3], "members": [1, 1, 1], "block": [0, 1, 1], "bits": [N.bitmap(x) for x in sets]})
    got = {(r["g"], r["sid"]) for b in N._by_bitmaps((0, 1), t) for r in b.to_pylist()}
    a, b, c = map(set, map(np.ndarray.tolist, sets))
    want = {(j, i) for i, j, x, y in ((1, 2, a, b), (1, 3, a, c)) if 100 * len(x & y) >= 75 * len(x | y)}
    assert want <= got and (3, 1) not in got and (3, 2) not in got


def test_copies_let_through_in_vain_lose_no_set(spark, monkeypatch):
    """A filter may let any document through; the one whose set is wanted still gives it."""
    whole = N.filter_of

    def lax(ids, col):
        cells, cell = whole(ids, col)
        cells.value.map[:] = 255
        return ids.sparkSession.sparkContext.broadcast(cells.value), cell

    monkeypatch.setattr(N, "filter_of", lax)
    rng = random.Random(13)
    base = [prose(rng, 80) for _ in range(12)]
    texts = [t for b in base for t in [b] * 6 + [near(rng, b, 2)] * 6]
    assert result(spark, docs(spark, texts)) == components(list(enumerate(texts)))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=80), st.integers(0, 80))
def test_span_connects_what_the_edges_do(n, edges, cut):
    edges = [(a % n, b % n) for a, b in edges]
    part, kept = np.arange(n), []
    for some in (edges[:cut], edges[cut:]):
        e = N._span(part, np.array([a for a, _ in some], int), np.array([b for _, b in some], int))
        kept += [some[k] for k in e.tolist()]
    parent = list(range(n))
    trees = 0
    for a, b in edges:
        if (i := N._find(parent, a)) != (j := N._find(parent, b)):
            parent[i] = j
            trees += 1
    assert len(kept) == trees
    assert all((part[a] == part[b]) == (N._find(parent, a) == N._find(parent, b)) for a in range(n) for b in range(n))


def test_linked_sets_at_a_common_shingle_make_fewer_rows_than_sets():
    """All 400 sets link with each other, and none is connected yet."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 62, 300, np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 62, 10, np.uint64))) for _ in range(400)]
    t = pa.table({"sid": range(400), "n": [len(x) for x in sets], "hi": [10**6] * 400, "label": range(400), "block": [0] * 400, "bits": [N.bitmap(x) for x in sets]})
    rows = [(r["g"], r["sid"]) for b in N._forest((0, 0), t) for r in b.to_pylist()]
    parent = list(range(400))
    for a, b in rows:
        parent[N._find(parent, a)] = N._find(parent, b)
    assert len(rows) == 399 and len({N._find(parent, x) for x in range(400)}) == 1


def test_salted_rows_are_not_broadcast(spark):
    """Spark's estimate leaves out that the small side is repeated."""
    few = spark.range(1000).select(F.col("id").alias("g"), F.lit(1).alias("blocks"))
    joined = spread_join(spark.range(100_000).select(F.pmod("id", F.lit(1000)).alias("g"), "id"), few, "g", "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAb \t\n\x0b\x0c\r\x1c\x85\x00\u00a0\u00e9", max_size=40), st.integers(250, 260).map(lambda k: "x" * k + " y z" + "x" * k)), max_size=30), st.integers(1, 300), st.integers(0, 3))
def test_shingles_of_texts_that_are_cut_together(texts, step, first):
    """Whatever texts share a step: sizes are those of brute force, and sets are equal where theirs are."""
    column = pa.array(texts, pa.string())[first:]
    was, N.STEP_BYTES = N.STEP_BYTES, step
    try:
        got = [s.tobytes() for s in N.shingle_sets(column)]
    finally:
        N.STEP_BYTES = was
    want = [shingles(t) for t in texts[first:]]
    assert [len(s) // 8 for s in got] == [len(s) for s in want]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
