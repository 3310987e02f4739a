import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse

import pytest
import zstandard

from vecloom.llm.secrets import find_secrets, joined, redact, scan_texts

from .helpers import docs, empty

S = 'password = "hunter22222"'


def plain(text):
    """The base rules, as they are written."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


CASES = [
    None, "", "nothing", S, "é secret: abcdefgh1 AKIAABCDEFGHIJKL01 " + "0af" * 20, "token=short", "token=token=abcdefgh", "secret: token: abcdefgh1",
    "PASSWD='Abcdefgh.1' api_key:x apikey = 12345678", "AKIAAKIAAKIAAKI", "AKIAAKIAAKIAAKIA", "\u017fecret=abcdefgh1", "deadbeef" * 4 + "g" + "deadbeef" * 3, "x" * 100_000 + S,
]


@pytest.mark.parametrize("text", CASES)
def test_base_rules(text):
    assert find_secrets(text)[0] == plain(text)


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


LAYERS = {
    "url": urllib.parse.quote(S), "url twice": urllib.parse.quote(urllib.parse.quote(S)), "unicode": "".join(f"\\u{ord(c):04x}" for c in S),
    "base64": b64(S), "base64 twice": b64(b64(S)), "gzip": b64(gzip.compress(S.encode())), "zstd of url": b64(zstandard.compress(urllib.parse.quote(S).encode())),
    "gzip of gzip": b64(gzip.compress(gzip.compress(S.encode()))), "entity": "".join(f"&#{ord(c)};" for c in S), "urlsafe": base64.urlsafe_b64encode(S.encode()).decode().rstrip("="),
}


@pytest.mark.parametrize("how", LAYERS)
def test_layers_are_unwrapped_and_spans_map_back(how):
    coded = LAYERS[how]
    text = f"Größe {coded} end"
    base, spans, cut = find_secrets(text)
    assert not cut and set(base) <= set(spans)
    found = [text[a:b] for a, k, b in spans if k == 0]
    assert found and all(f in coded for f in found)
    assert "hunter22222" not in redact(text, spans)


def test_partly_encoded_span_is_exact():
    text = "x pass%77ord=abcdefgh1 y"
    assert [text[a:b] for a, _, b in find_secrets(text)[1]] == ["pass%77ord=abcdefgh1"]


def test_decoding_ends():
    assert find_secrets("%25" * 500)[1] == []
    deep = S
    for _ in range(12):
        deep = urllib.parse.quote(deep)
    assert find_secrets(deep)[1]


def test_bomb_is_bounded_and_counted():
    bomb = b64(gzip.compress(b"a" * 5_000_000))
    assert find_secrets(bomb, most=1_000_000)[2] == 1


def test_redact_merges_overlaps():
    assert redact("abcdefgh", [(1, 0, 4), (2, 1, 5), (6, 2, 7)]) == "a[SECRET]f[SECRET]h"


def test_table(spark):
    rows = scan_texts(docs(spark, CASES, clash=True), ["doc_id"]).orderBy("doc_id").collect()
    for r, t in zip(rows, CASES):
        base = plain(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.redacted is None) == (t is None)
    assert scan_texts(empty(spark), ["doc_id"]).count() == 0


def zstd(x):
    return zstandard.compress(x.encode())


JUNK = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(200))
PARTS = {
    **{f"behind {p}": p + b64(S) for p in ("https://host/cb/", "https://host/c/", "key_", "a-", "ab", "abc")},
    "gzip behind a path": "https://host/cb/" + b64(gzip.compress(S.encode())),
    "wrapped gzip": base64.encodebytes(gzip.compress((JUNK + S).encode())).decode(), "wrapped zstd": base64.encodebytes(zstd(JUNK + S)).decode().replace("\n", "\r\n  "),
    "over a line end": "\n".join(re.findall(".{1,20}", b64("some words before it " + S))), "narrow lines": "\n".join(re.findall(".{1,8}", b64(S))),
    "two gzip members": b64(gzip.compress(b"nothing") + gzip.compress(S.encode())), "secret over members": b64(gzip.compress(S[:9].encode()) + b"\0" * 5 + gzip.compress(S[9:].encode())),
    "two bz2 streams": b64(bz2.compress(b"nothing") + bz2.compress(S.encode())), "two xz streams": b64(lzma.compress(b"nothing") + lzma.compress(S.encode())),
    "three zstd frames": b64(zstd("a") + b"\x50\x2aM\x18\x03\0\0\0abc" + zstd(S)), "text behind gzip": b64(gzip.compress(b"nothing") + b"\0" + S.encode()),
    "cut gzip": b64(gzip.compress((S + JUNK).encode())[:-500]),
}


@pytest.mark.parametrize("how", PARTS)
def test_runs_out_of_step_wrapped_and_of_several_members(how):
    text = f"Größe {PARTS[how]} end"
    _, spans, _ = find_secrets(text)
    assert any(k == 0 for _, k, _ in spans) and text.startswith("Größe ") and all(6 <= a < b <= len(text) - 4 for a, _, b in spans)


def test_prefix_of_a_run_stays():
    text = "https://host/cb/" + b64(S)
    assert redact(text, find_secrets(text)[1]).startswith("https://host/cb/")


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
@pytest.mark.parametrize("inner", [S, b64(S)])
def test_long_layers_are_scanned_to_the_end(pack, inner):
    for at in (99_990, 93_740, 350_000):
        _, spans, long = find_secrets(b64(pack((" " * at + inner + " " * 50_000).encode())), most=100_000)
        assert long == 1 and {k for _, k, _ in spans} == {0}
