"""Secret scans that unwrap encoded layers.

A worklist holds layers of text with, for each character, the span of the
original that it comes from. Each layer is scanned; url escapes and Unicode
escapes in it are undone in place, base64 runs (and what is compressed in them)
become layers of their own, until nothing new appears. A layer that was seen at
the same place is not taken up again, which ends cycles.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Bytes of the shortest secret, and characters of its base64: shorter stretches and runs are no candidates.
_SHORTEST, _SHORTEST_BASE64 = 14, 18
_LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE_END = re.compile(rb"[ \t]*\r?\n[ \t]*")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: Starts of compressed data: gzip, bzip2, xz, zstd with its skippable frames, and the common ones of zlib.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2aM\x18|\x78[\x01\x5e\x9c\xda]", re.DOTALL)
_SKIPPED = re.compile(rb"[\x50-\x5f]\x2aM\x18")
_ZEROS = re.compile(rb"\x00*+")
_PIECE = 1 << 20
#: Text as UTF-8, without control characters.
_STRETCH = re.compile(rb"(?:[\t\n\r -~]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
                      rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++")
_HEX_BYTES = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_B64_BYTES = bytes(120 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for c in range(256))
_IS_BASE64 = np.frombuffer(_B64_BYTES, np.uint8) == 120

Span = tuple[int, int, int]  # start, number of the kind, end


def scan(text: str, raw: bytes | None = None) -> list[Span]:
    """Secrets of one layer, leftmost and not overlapping for each kind, by start."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if b"x" * 32 in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _edited(text: str, starts: np.ndarray, ends: np.ndarray, edits: list[tuple[int, int, str, list[int]]]):
    """The layer with edits (from, to, new text, source length of each new character)."""
    parts, s, e, at = [], [], [], 0
    for a, b, new, lengths in edits:
        parts += [text[at:a], new]
        cut = a + np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        s += [starts[at:a], starts[cut[:-1]]]
        e += [ends[at:a], ends[cut[1:] - 1]]
        at = b
    parts.append(text[at:])
    return "".join(parts), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])


def _undo_url(m: re.Match) -> tuple[int, int, str, list[int]]:
    new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    return m.start(), m.end(), new, [3 * len(c.encode("utf-8", "surrogateescape")) for c in new]


def _undo_unicode(m: re.Match) -> tuple[int, int, str, list[int]] | None:
    code = int(m[5]) if m[5] else int(next(g for g in (m[1], m[2], m[3], m[4], m[6]) if g), 16)
    return (m.start(), m.end(), chr(code), [m.end() - m.start()]) if code < 0x110000 else None


def _inflate(data: bytes, at: int, end: list[int]) -> Iterator[bytes]:
    """What one member or frame at `at` holds, in pieces; its end goes to end[0]. A broken or cut one gives what comes before that."""
    head = data[at:at + 8]
    if _SKIPPED.match(head):
        if len(head) == 8:
            end[0] = min(at + 8 + int.from_bytes(head[4:], "little"), len(data))
        return
    step = 1 << 14
    try:
        if head[:1] in (b"\x1f", b"\x78"):
            z = zlib.decompressobj(47)
        elif head[:1] == b"B":
            z = bz2.BZ2Decompressor()
        elif head[:1] == b"\xfd":
            z = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        else:
            import zstandard

            z, step = zstandard.ZstdDecompressor().decompressobj(), 64  # gives all that a step holds at once: 2 MB at most
        while not z.eof and at < len(data):
            piece = data[at:at + step]
            at += len(piece)
            while True:
                out = z.decompress(piece) if step == 64 else z.decompress(piece, _PIECE)
                if out:
                    yield out
                piece = getattr(z, "unconsumed_tail", b"")
                if z.eof or step == 64 or getattr(z, "needs_input", not piece and len(out) < _PIECE):
                    break
        if z.eof:
            end[0] = at - len(z.unused_data)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return
    except Exception as e:
        if type(e).__name__ != "ZstdError":
            raise


def _stream(data: bytes, at: int, end: list[int]) -> Iterator[bytes]:
    """What the members or frames from `at` on hold, one after the other (zeros may lie between); the last one's end goes to end[0]."""
    while True:
        stop = [at]
        yield from _inflate(data, at, stop)
        if stop[0] == at:
            return
        end[0] = at = stop[0]
        at = _ZEROS.match(data, at).end()
        if not _MAGIC.match(data, at):
            return


def _unpacked(data: bytes, most: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, content, first window of a long one) of what is compressed in data, wherever it starts.

    Content of more than `most` bytes comes in windows of that size that overlap by a sixteenth.
    """
    pos = 0
    while pos < len(data):
        m = _MAGIC.search(data, pos)
        odd = pos == 0 and data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2]) % 31 == 0
        if not m and not odd:
            return
        at = 0 if odd else m.start()
        end, held, long = [at], bytearray(), False
        for piece in _stream(data, at, end):
            held += piece
            while len(held) > most:
                yield at, len(data), bytes(held[:most]), not long
                long = True
                del held[:max(most - most // 16, 1)]
        if len(held) >= _SHORTEST:
            yield at, len(data) if long or end[0] == at else end[0], bytes(held), False
        pos = end[0] if end[0] > at else at + 1


def _texts(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Stretches of data that are text and may hold a secret."""
    for m in _STRETCH.finditer(data):
        if m.end() - m.start() >= _SHORTEST:
            yield m.start(), m[0]


def _base64_layers(text: str, starts: np.ndarray, ends: np.ndarray, most: int):
    """What base64 runs hold: text with starts and ends of its characters, or unpacked bytes with one start and end.

    A run may go on over line ends. It may also start with what isn't base64 (a
    path, a name), so it is decoded from each of its first four characters. As a
    line end may also end the run, lines are decoded alone too.
    """
    for group in _BASE64.finditer(text):
        if group.end() - group.start() < _SHORTEST_BASE64:
            continue
        runs = [(group.start(), group.end())]
        if "\n" in group[0]:
            runs += [(m.start(), m.end()) for m in _LINE.finditer(text, *group.span()) if m.end() - m.start() >= _SHORTEST_BASE64]
        for a, b in runs:
            raw = np.frombuffer(text[a:b].encode(), np.uint8)
            own = np.flatnonzero(_IS_BASE64[raw])
            chars = raw[own].tobytes().translate(_STANDARD)
            if len(chars) < _SHORTEST_BASE64:
                continue
            for off in range(4):
                part = chars[off:len(chars) - ((len(chars) - off) % 4 == 1)]
                data = base64.b64decode(part + b"=" * (-len(part) % 4))
                at = own[off:off + len(part)] + a
                for i, piece in _texts(data):
                    new = piece.decode("utf-8")
                    n = np.fromiter((len(c.encode()) for c in new), np.int64, len(new)) if not new.isascii() else np.ones(len(new), np.int64)
                    stop = i + np.cumsum(n)
                    yield new, starts[at[(stop - n) * 8 // 6]], ends[at[np.minimum((stop * 8 - 1) // 6, len(at) - 1)]], False
                for i, j, content, long in _unpacked(data, most):
                    last = b - 1 if j == len(data) else at[(j * 8 - 1) // 6]
                    yield content, starts[at[i * 8 // 6]], ends[last], long


def _inside(layer: str | bytes, starts, ends, most: int):
    """The layers in a layer, one at a time: (text, starts, ends, long), or (bytes, start, end, long) of what was compressed."""
    if isinstance(layer, bytes):
        for _, piece in _texts(layer):
            new = piece.decode("utf-8")
            yield new, np.broadcast_to(starts, len(new)), np.broadcast_to(ends, len(new)), False
        for _, _, content, long in _unpacked(layer, most):
            yield content, starts, ends, long
        return
    for pattern, undo in ((_URL, _undo_url), (_UNICODE, _undo_unicode)):
        if edits := [x for x in map(undo, pattern.finditer(layer)) if x]:
            yield *_edited(layer, starts, ends, edits), False
    yield from _base64_layers(layer, starts, ends, most)


def find_secrets(text: str | None, most: int = 64 << 20) -> tuple[list[Span], list[Span], int]:
    """(spans of the text itself, all spans with those of its layers, layers that were longer than `most` bytes).

    Spans are in code points of the whole text, end exclusive. Null is the empty
    text. `most` bounds memory, against compression bombs: what unpacks to more is
    scanned to its end in windows of that size and counted. Only a layer that lies
    over the edge of a window and doesn't fit the overlap (a sixteenth) is met in parts.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    base = scan(text, raw)
    coded = b"%" in raw or b"\\" in raw or b"&#" in raw
    if not coded and b"x" * _SHORTEST_BASE64 not in (_LINE_END.sub(b"", raw) if b"\n" in raw else raw).translate(_B64_BYTES):
        return base, base, 0
    found, over = set(base), 0
    same = np.arange(len(text) + 1)
    seen: set[tuple[bytes, int]] = set()
    work = [iter([(text, same[:-1], same[1:], False)])]
    while work:
        if (item := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, starts, ends, long = item
        over += long
        binary = isinstance(layer, bytes)
        coded = layer if binary else layer.encode("utf-8", "surrogatepass")
        key = (hashlib.blake2b(coded, digest_size=16, person=b"b" if binary else b"").digest(), int(starts if binary else starts[0] if len(starts) else 0))
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1 and not binary:
            found.update((int(starts[a]), k, int(ends[b - 1])) for a, k, b in scan(layer, coded))
        work.append(_inside(layer, starts, ends, most))
    return base, sorted(found), over


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping or touching spans replaced by the mark."""
    out, at, until = [], 0, -1
    for a, _, b in sorted(spans):
        if a > until:
            out += [text[at:a], mark] if a >= at else []
            at = b
        until = max(until, b)
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_cut_off long, redacted string"


def scan_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, the numbers of the text's own secrets by kind, the digest of their spans, all spans, and the redacted text.

    Null texts have no spans and stay null when redacted; rows stay as often as they come; other columns are left out.
    """
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [RESULT])
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in (p for b in batches for p in slices(b, "_text")):
            rows = []
            for t in batch.column("_text").to_pylist():
                base, spans, over = find_secrets(t)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), over, t if not spans else redact(t, spans)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(types), types))], [*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(table(spark, sf_dir, "documents"), ["doc_id"]).drop("redacted", "n_spans")
