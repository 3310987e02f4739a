import random
import zlib

import numpy as np
import pytest

from vecloom.llm import compression as C
from vecloom.llm import media as M

from .helpers import docs, empty, prose

SYLLABLES = {"aa": "tha ing er the and on sh wh ou", "bb": "sch keit ung ein ver ge der pf", "cc": "ción ado que los mente ar ez"}


def speak(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(0)
    texts = [prose(rng, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for i in range(240)]
    d = docs(spark, texts, clash=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    model = C.fit_quality(d, labels)
    got = {r.doc_id: r.score for r in C.score_quality(d, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(120, 240)) >= 115


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = C.fit_quality(docs(spark, ["a"]), none)
    rows = C.score_quality(docs(spark, [None, "", "x " * 200_000]), model, ["doc_id"]).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert C.score_quality(empty(spark), model, ["doc_id"]).count() == 0


def test_sizes_cover_the_whole_text():
    a = C.sizes(["x" * 10, "ab" * 50_000, None], [b"abab" * 10])
    assert a[:, -1].tolist() == [10, 100_000, 0] and a[1, 0] > a[0, 0] and a[2, 0] == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(200)]
    texts = [speak(rng, k, 40) for k in langs]
    rows = [(i, t, k if i < 100 else None, "s", 0) for i, (t, k) in enumerate(zip(texts, langs))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    model = C.fit_languages(d)
    got = {r.doc_id: r for r in C.predict_languages(d, model, ["doc_id"]).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in range(100, 200)) >= 98
    more = C.predict_languages(docs(spark, [None, "", "123 !!", "ß"]), model, ["doc_id"]).collect()
    assert [r.lang_pred == "und" for r in sorted(more, key=lambda r: r.doc_id)] == [True, True, True, False]
    assert all(r.score == 0 and not r.accepted for r in more if r.lang_pred == "und")
    assert C.predict_languages(empty(spark), model, ["doc_id"]).count() == 0
    assert C.predict_languages(docs(spark, ["abc"]), {}, ["doc_id"]).first().lang_pred == "und"


def test_held_out_share_is_by_crc(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", C.crc32_of("doc_id").alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.doc_id).encode()) for r in got)


# ---- images ----


def picture(rng, n=160):
    return np.clip(0.8 * (M.resize(rng.random((14, 14)) * 255, n, n) + M.resize(rng.random((40, 40)) * 60, n, n)), 0, 255)


def edited(rng, x, how):
    if how == "crop":
        return x[20:140, 15:150]
    if how == "bright":
        return np.clip(x * 0.8 + 20, 0, 255)
    if how == "noise":
        return np.clip(x + rng.normal(0, 3, x.shape), 0, 255)
    if how == "box":
        y = x.copy()
        y[10:50, 10:70] = 255
        return y
    if how == "turned":
        return np.rot90(x)
    return M.resize(x, 107, 107)


def row(i, x):
    x = np.rint(x).astype(np.uint8)
    return i, {"height": x.shape[0], "width": x.shape[1], "nChannels": 1, "data": x.tobytes()}


@pytest.mark.parametrize("how", ["crop", "bright", "noise", "box", "turned", "half"])
def test_edits_agree_and_others_do_not(how):
    rng = np.random.default_rng(0)
    a = [picture(rng) for _ in range(4)]
    k, e = [M.describe(x) for x in a], [M.describe(np.rint(edited(rng, x, how))) for x in a]
    assert all(M.agree(k[i], e[i]) >= 3 * M.VOTES for i in range(4))
    assert all(M.agree(k[i], e[j]) < M.VOTES for i in range(4) for j in range(4) if i != j)


def test_copies_are_found(spark):
    rng = np.random.default_rng(1)
    a = [picture(rng) for _ in range(6)]
    rows = [row(i, x) for i, x in enumerate(a)]
    rows += [row(10 + i, edited(rng, a[i], how)) for i, how in enumerate(["crop", "bright", "noise", "box", "half"])]
    rows += [row(20, a[5]), row(20, a[5]), (30, None), (31, {"height": 5, "width": 5, "nChannels": 3, "data": b"short"}), row(32, np.zeros((64, 64))), row(33, np.zeros((64, 64))), row(34, np.zeros((0, 0)))]
    df = spark.createDataFrame(rows, f"image_id long, image {M.IMAGE}")
    got = [(r.image_id, r.component_id) for r in M.image_copies(df).collect()]
    want = [(i, i) for i in range(6)] + [(10 + i, i) for i in range(5)] + [(20, 5), (20, 5), (30, 30), (31, 31), (32, 32), (33, 32), (34, 34)]
    assert sorted(got) == sorted(want)
    assert M.image_copies(df.limit(0)).count() == 0


def test_vectors_as_pictures(spark):
    v = spark.createDataFrame([(0, [0.5] * 64), (1, None), (2, [float("nan")] * 64), (3, [])], "id long, v array<float>")
    got = {r.image_id: r.image for r in M.pictures_of_vectors(v).collect()}
    assert got[0] is not None and got[1] is None and got[2] is None and got[3] is None


def test_null_and_repeated_image_ids(spark):
    rng = np.random.default_rng(2)
    a, b, c = (picture(rng) for _ in range(3))
    rows = [row(None, a), row(None, edited(rng, a, "bright")), row(None, b), row(4, edited(rng, b, "bright")), row(5, c), row(5, edited(rng, b, "noise")), (None, None)]
    got = [(r.image_id, r.component_id) for r in M.image_copies(spark.createDataFrame(rows, f"image_id long, image {M.IMAGE}")).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (None, None), (None, 4), (4, 4), (5, 5), (5, 4), (None, None)], key=str)


def own_pictures(spark, n):
    """As the registered query draws them, from random unit vectors."""
    v = np.random.default_rng(5).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = M.pictures_of_vectors(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")).collect()
    return [M.to_gray(*r.image) for r in sorted(rows, key=lambda r: r.image_id)]


OWN = {
    "crop to 80 %": lambda rng, x: x[9:86, 9:86], "crop to 50 %": lambda rng, x: x[14:82, 14:82], "brightness": lambda rng, x: x * 0.8 + 20,
    "noise 3": lambda rng, x: x + rng.normal(0, 3, x.shape), "noise 10": lambda rng, x: x + rng.normal(0, 10, x.shape), "quarter turn": lambda rng, x: np.rot90(x),
    **{f"x{z}": (lambda rng, x, z=z: M.resize(x, round(96 * z), round(96 * z))) for z in (0.9, 0.8, 0.75, 0.67, 0.5, 1.5)},
}


def test_recall_of_each_edit_on_the_querys_pictures(spark):
    """Copies that a brute force over all pairs links are found through two shared words, 9 in 10 of all at least; no two others link."""
    a = own_pictures(spark, 30)
    k, w = [M.describe(x) for x in a], [M.words_of(M.describe(x)) for x in a]
    for how, edit in OWN.items():
        rng = np.random.default_rng(1)
        e = [M.describe(np.rint(np.clip(edit(rng, x), 0, 255)).astype(np.float32)) for x in a]
        linked = [M.agree(k[i], e[i]) >= M.VOTES and len(np.intersect1d(w[i], M.words_of(e[i]))) >= M.LEAST_WORDS for i in range(30)]
        assert sum(linked) >= 27, (how, sum(linked))
    assert all(M.agree(k[i], k[j]) < M.VOTES for i in range(30) for j in range(i))


def test_against_all_pairs_with_a_large_group(spark):
    """Components are those of comparing all pairs; copies of one picture make far fewer rows than pairs."""
    a = own_pictures(spark, 12)
    rng = np.random.default_rng(2)
    edits = list(OWN.values())
    pics = [*a, *(edits[i % len(edits)](rng, a[i % 4]) for i in range(60)), *(a[7] + rng.normal(0, 2, a[7].shape) for _ in range(40))]
    order = rng.permutation(len(pics))
    rows = [row(int(i), np.clip(pics[i], 0, 255)) for i in order]
    k = {i: M.describe(M.to_gray(*(im[f] for f in ("height", "width", "nChannels", "data")))) for i, im in rows}
    up = {i: i for i in k}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(k):
        for j in sorted(k):
            if i < j and top(i) != top(j) and M.agree(k[i], k[j]) >= M.VOTES:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, im, "x", 1) for i, im in rows], f"image_id long, image {M.IMAGE}, sid string, token long")
    got = {r.image_id: r.component_id for r in M.image_copies(df).collect()}
    assert sum(got[i] == top(i) for i in got) >= len(got) - 1


def test_exact_finds_copies_that_share_no_words(spark, monkeypatch):
    """Words as long as for very many images lose copies; exact finds what a brute force over all pairs does, block by block."""
    monkeypatch.setattr(M, "word_bits", lambda images: 64)
    monkeypatch.setattr(M, "EXACT_IMAGES", 10)
    a = own_pictures(spark, 10)
    rng = np.random.default_rng(3)
    pics = [*a, *(np.clip(OWN[how](rng, x), 0, 255) for x in a for how in ("x0.8", "x0.67"))]
    rows = [row(i, x) for i, x in enumerate(pics)] + [(40, None), row(41, pics[3])]
    k = {i: M.describe(M.to_gray(*(im[f] for f in ("height", "width", "nChannels", "data")))) for i, im in rows if im}
    up = {i: i for i, _ in rows}
    for i in k:
        for j in k:
            if i < j and up[i] != up[j] and M.agree(k[i], k[j]) >= M.VOTES:
                x, y = sorted((up[i], up[j]))
                up = {n: x if v == y else v for n, v in up.items()}
    df = spark.createDataFrame(rows, f"image_id long, image {M.IMAGE}")
    assert {r.image_id: r.component_id for r in M.image_copies(df, exact=True).collect()} == up
    assert {r.image_id: r.component_id for r in M.image_copies(df).collect()} != up
    assert M.image_copies(df.limit(0), exact=True).count() == 0


def test_near_keypoints_are_all_found():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    b = a[rng.integers(0, 2000, 500)] ^ np.packbits(rng.random((500, 256)) < rng.uniform(0, 0.25, (500, 1)), axis=1)
    got = {p for q, f in M._Nearby(a).of(b, lambda q, f: f != 7) for p in zip(q.tolist(), f.tolist())}
    d = np.bitwise_count(b.view(np.uint64)[:, None] ^ a.view(np.uint64)[None]).sum(2)
    assert (d == M.MOST_BITS).any() and got == {(q, f) for q, f in np.argwhere(d <= M.MOST_BITS).tolist() if f != 7}


def test_the_query_compares_pictures_that_share_no_words(spark, monkeypatch, tmp_path):
    """Registered op10: near vectors whose pictures agree are linked, whatever words they share."""
    monkeypatch.setattr(M, "word_bits", lambda images: 64)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(10, 64))
    v = [*v, *(x + rng.normal(0, 0.35, 64) for x in v for _ in range(2))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    pics = M.pictures_of_vectors(df).collect()
    k = {r.image_id: M.describe(M.to_gray(*r.image)) for r in pics}
    up = {i: i for i in k}
    for i in k:
        for j in k:
            if i < j and up[i] != up[j] and M.agree(k[i], k[j]) >= M.VOTES:
                x, y = sorted((up[i], up[j]))
                up = {n: x if c == y else c for n, c in up.items()}
    assert {r.image_id: r.component_id for r in M.op10_image_copies(spark, str(tmp_path)).collect()} == up
    assert {r.image_id: r.component_id for r in M.image_copies(M.pictures_of_vectors(df)).collect()} != up


def test_neighbours_at_a_token(spark):
    """All pairs of up to WINDOW components, else those next to each other and all with the first; any number of rows a token."""
    rows = [(1, g, g) for g in range(10)] + [(2, g, 100 + g) for g in range(50)] + [(2, g, 99 + g) for g in range(50)] + [(3, 1, 1)]
    got = sorted((r.la, r.lb, r.a, r.b) for r in M._neighbours(spark.createDataFrame(rows, "token long, label long, sid long")).collect())
    want = [(i, j, i, j) for i in range(10) for j in range(i + 1, 10)]
    want += [(i, j, 99 + i, 99 + j) for i in range(50) for j in range(i + 1, 50) if j - i < M.WINDOW or i == 0]
    assert got == sorted(want)
