import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from vecloom.llm import packing as P
from vecloom.llm.common import Scratch, shared_dir
from vecloom.llm.token_files import id_type, read_token_files, write_token_files
from vecloom.llm.tokens import WordTokenizer

from .helpers import docs, empty, prose

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "x\n y", "x \n\ny z", "nb\xa0sp ace", "<|endoftext|> a<|endoftext|>", "x <|ENDOFTEXT|> <|startoftext|>Y  <|endoftext|>\n", "<|endof text|>", "İstanbul ΣΑΣ don't I'll", "\n\n", "a\tb  c", "é ́x", "\x1c a\x1cb", "a\r\nb", "1 22 333,4", "日本 語"]


def whole(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.fixture(scope="module")
def tokenizers():
    return {f: WordTokenizer(public_tokenizers.path(f), cache_words=50) for f in FILES}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÉß 's\n\t\xa0  .,1!<|>Ώ"), max_size=30), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    for f in FILES:
        w = _TOK.setdefault(f, WordTokenizer(public_tokenizers.path(f), cache_words=50))
        ids, off = w.encode(pa.array(texts, pa.string()), 7)
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == w.whole(t).tolist() + [7]


_TOK: dict = {}


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(tokenizers, name):
    texts = [*ODD, prose(random.Random(0), 5000)]
    ids, off = tokenizers[name].encode(pa.array(texts, pa.string()), 7)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == whole(name, t, 7)


def test_id_type():
    assert (id_type(65536), id_type(65537)) == (np.dtype("<u2"), np.dtype("<u4"))


def test_token_files_round_trip(spark):
    texts = [(k * 7 % 23, t) for k, t in enumerate(ODD)]
    uri = shared_dir(spark)
    write_token_files(docs(spark, texts, clash=True), uri, public_tokenizers.path(FILES[0]), 1)
    got = {r.doc_id: r for r in read_token_files(spark, uri).collect()}
    start = 0
    for d, t in sorted(texts):
        ids = np.array(whole(FILES[0], t, 1), "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_nothing_and_of_repeated_rows(spark):
    uri = shared_dir(spark)
    write_token_files(empty(spark), uri, public_tokenizers.path(FILES[0]), 1)
    assert read_token_files(spark, uri).count() == 0
    uri = shared_dir(spark)
    write_token_files(docs(spark, [(3, "a"), (3, "a"), (1, None)]), uri, public_tokenizers.path(FILES[0]), 1)
    assert sorted((r.doc_id, r.start) for r in read_token_files(spark, uri).collect()) == [(1, 0), (3, 1), (3, 3)]


def check_packing(rows, texts, capacity):
    at, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, t in texts:
        ids = np.array(whole(FILES[1], t, 2), "<u4")
        pieces = sorted(at[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        where = 0
        for p in pieces:
            assert p.start == where and zlib.crc32(ids[where:where + p.length].tobytes()) == p.ids_crc32
            assert p.piece == 0 or p.length == capacity
            where += p.length
        assert where == len(ids)
    for parts in seqs.values():
        where = 0
        for offset, length in sorted(parts):
            assert offset == where
            where += length
        assert where <= capacity
    return len(seqs)


def test_packing(spark):
    rng = random.Random(5)
    texts = [(i, prose(rng, rng.randint(1, 60))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, prose(rng, 900))]
    rows = P.pack_documents(docs(spark, texts, clash=True), public_tokenizers.path(FILES[1]), 2, capacity=128).collect()
    n = check_packing(rows, texts, 128)
    least = -(-sum(r.length for r in rows) // 128)
    assert n <= least * 1.02 + 1


def test_packing_edges(spark):
    path = public_tokenizers.path(FILES[1])
    assert P.pack_documents(empty(spark), path, 2).count() == 0
    rows = P.pack_documents(docs(spark, [(1, "same"), (1, "same"), (None, None)]), path, 2).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 200)
    s = sizes.tolist()
    a, b = (P._pack(rng.permutation(200), s, 128) for _ in range(2))
    child = P.crossover(a, b, s, 128, rng, 0.5)
    assert sorted(i for x in child for i in x) == list(range(200))
    assert all(sum(s[i] for i in x) <= 128 for x in child)


def test_evolution_beats_or_meets_its_start():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 70, 120)
    start = P._pack(np.arange(120), sizes.tolist(), 128)
    best = P.evolve(sizes, 128, 3, [start], 4, 20)[0]
    assert len(best) <= len(start)
    assert P._bins_of(P._assign(best, 120)) == [sorted(x) for x in best]


def test_islands_are_the_same_again(spark):
    pieces = spark.range(500).selectExpr("id AS uid", "CAST(10 + id * 37 % 60 AS INT) AS length")
    one, two = (sorted(map(tuple, P.islands(pieces, Scratch(spark), 128, cell_size=200).collect())) for _ in range(2))
    assert one == two


def test_pack_needs_no_more_sequences_than_best_fit_over_all(spark):
    """Pieces of many cells meet: a few thousand are packed at least as well as in one place."""
    sizes = np.random.default_rng(3).integers(100, 900, 4000)
    pieces = spark.createDataFrame(list(enumerate(sizes.tolist())), "uid long, length long")
    rows = P.pack(pieces, Scratch(spark), 1024).join(pieces, "uid").collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 4000 and max(fill.values()) <= 1024
    assert len(fill) <= len(P._pack(np.argsort(-sizes, kind="stable"), sizes.tolist(), 1024))
