"""N-gram Jaccard join: near-duplicate documents by a prefix-tree join of shingle sets.

Sets of shingle hashes are put in one global order: shingles that a count sketch
over all documents shows to be common come last, the more common the later; others go by hash. Two sets with
a Jaccard similarity of 3/4 or more share a shingle among the first n - ceil(3n/4) + 1
of each, so sets meet at the shingles of their prefixes. Sets that meet are
compared in blocks: the block's sets are stored in a trie in the global order, and
the other sets run down it together; the overlap at a node is shared by all sets
below it, and a subtree is left where the overlap so far and the lengths that
remain can't reach the threshold. Links are exact; they connect components.

1. Each set goes to the block of the set it shares most prefix shingles with. A
   group of copies, however large, is spread over blocks that all hold its hub.
2. What is left are prefix shingles at which different components meet. A set at
   place i of which a shingle stands can share n - i with what meets it there first,
   which bounds the other's size: places whose bounds no other set meets are left out,
   so sets that have a common text besides much of their own cost little. At a shingle
   of many sets a task compares parity bitmaps: two sets differ by as many shingles at
   least as their bitmaps by bits, so most pairs are ruled out there and no row is
   made of them. Sets that likely link there are many when they belong together, so
   first a spanning forest of a shingle's components by the closest bitmaps is looked
   at, and only components that it doesn't connect meet again. For every
   two components left the sets of the one that share enough shingles with the
   other run down tries of the other's sets. No pair of documents is made for this,
   and within a component nothing is compared again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, connected_components, filter_of, grouped, meeting, spread_join, table
from .tokens import slices

#: Cells of the sketch of document frequencies (2**22), in rows of 2**15: 8 MB a task while it counts, 4 MB in the end, whatever the input.
SKETCH_BITS = 22
ROW_BITS = 15
#: Sets in a block, and shingles in it: a block is what one task holds.
BLOCK_SETS = 256
BLOCK_SHINGLES = 1_000_000
#: Sets at a shingle beyond which they are compared by their bitmaps; sets, and bytes of bitmaps, that are compared in one task.
HOT_SETS = 16
HOT_BLOCK, HOT_BYTES = 16384, 48 << 20
#: Bits of the smallest and the largest bitmap.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: One in so many of a set's shingles may be shared before the place from which its bound is reckoned.
SLACK = 400
#: Bytes of texts that are cut into shingles together, and bytes of a word beyond which it is hashed alone.
STEP_BYTES, LONG_WORD = 1 << 18, 256
#: Shingles that are added to the sketch together.
COUNTED = 1 << 18
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(ASCII_SPACE.encode())] = False
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


# ---- sets ----


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:stop], eight bytes at a time over all words; data has eight bytes after the last word."""
    import xxhash

    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = stop - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, at, left = slice(None), start, size
    while len(at):
        h[rows] = _mix((h[rows] ^ (loads[at] & _MASKS[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93))
        go = np.flatnonzero((left > 8) & (left <= LONG_WORD))
        rows = go if isinstance(rows, slice) else rows[go]
        at, left = at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:stop[i]])
    return h


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 62-bit hashes of its n-word shingles; fewer words are one shingle, none (and null) give none.

    Texts are worked on together, some STEP_BYTES at a time.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
        ends = at[i:j + 1] - at[i]
        data = (raw[at[i]:at[j]].to_pybytes() if raw is not None else b"").lower() + b" " * 8
        inside = _IN_WORD[np.frombuffer(data, np.uint8)]
        # a word begins or ends where this changes, and where a text ends within it
        change = np.empty(len(inside), bool)
        change[0], change[1:] = inside[0], inside[1:] != inside[:-1]
        start, stop = inside & change, ~inside & change
        cut = ends[1:-1]
        cut = cut[(cut > 0) & inside[cut] & inside[cut - 1]]
        start[cut] = stop[cut] = True
        start, stop = np.flatnonzero(start), np.flatnonzero(stop)
        w = _word_hashes(data, start, stop)
        h = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k:k + len(h)]
        h = _mix(h) >> np.uint64(2)
        first = np.searchsorted(start, ends).tolist()
        for a, b in zip(first, first[1:]):
            if b - a >= n:
                s = np.sort(h[a:b - n + 1])
                keep = np.empty(len(s), bool)
                keep[0], keep[1:] = True, s[1:] != s[:-1]
                yield s[keep]
            elif a == b:
                yield np.zeros(0, np.uint64)
            else:
                one = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    one = one * np.uint64(0x9E3779B97F4A7C15) + w[k]
                yield _mix(one) >> np.uint64(2)
        i = j


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of one digest: documents with equal sets share both."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def set_id(s: np.ndarray, second: dict[int, int]) -> int:
    """The first half, but the second for those sets that chance gave the first half of another; second has that other's second half."""
    sid, alt = set_ids(s)
    return alt if second.get(sid, alt) != alt else sid


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of some 2 to 4 cells a shingle: what two bitmaps differ by, their sets do at least."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool)).tobytes()


def _summaries(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, key, n_shingles, sid and alt (halves of the set's digest) of each document. kind 1: rows of a task's sketch, compressed."""

    def count(cells: np.ndarray, sets: list[np.ndarray]) -> None:
        if sets:
            c = np.sort((np.concatenate(sets) >> np.uint64(62 - SKETCH_BITS)).astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])[:len(c)])
            c, more = c[first], np.diff(np.append(first, len(c)))
            cells[c] = np.minimum(cells[c] + more, 40_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("alt", pa.int64()), ("row", pa.int64()), ("cells", pa.binary())])
        cells = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in (p for b in batches for p in slices(b, "text")):
            n, sid, alt = [], [], []
            held, size = [], 0
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                first, second = set_ids(s) if len(s) else (None, None)
                sid.append(first)
                alt.append(second)
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    count(cells, held)
                    held, size = [], 0
            count(cells, held)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(alt, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=schema)
        rows = cells.reshape(-1, 1 << ROW_BITS)
        for r in np.flatnonzero(rows.any(1)).tolist():
            yield pa.RecordBatch.from_pylist([{"kind": 1, "row": r, "cells": zlib.compress(rows[r].tobytes(), 1)}], schema=schema)

    return docs.mapInArrow(run, "kind int, doc_id long, key long, n long, sid long, alt long, row long, cells binary")


def _common_cells(sketch: DataFrame, shingles: int) -> np.ndarray:
    """0 to 3 for each cell, by how far its count stands out from what the mean explains: 1 MB of bits, whatever the input."""
    mean = shingles / (1 << SKETCH_BITS)
    steps = [mean + k * mean**0.5 + more for k, more in ((2, 2), (5, 5), (12, 20))]

    def add(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ROW_BITS, np.int64)
        for c in t["cells"].to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint16)
        level = sum(total > x for x in steps)
        yield pa.RecordBatch.from_pydict({"row": [int(key[0])], "bits": [np.packbits(np.stack([level >> 1, level & 1]).astype(bool)).tobytes()]})

    out = np.zeros(1 << SKETCH_BITS, np.uint8).reshape(-1, 1 << ROW_BITS)
    for r in grouped(sketch.select("row", "cells"), ["row"], add, "row long, bits binary").collect():
        high, low = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).reshape(2, -1)
        out[r["row"]] = 2 * high + low
    return out.ravel()


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the global order: the top two bits put common shingles last."""
    top = common[(s >> np.uint64(62 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(62)
    return np.sort(s | top)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


# ---- prefix tree ----


def _trie(sets: list[np.ndarray], rows: list[int]):
    """Nodes in preorder: (shingles of the node, sets that end there, least and largest size below, depth before it, next node outside).

    Sets are sorted by their sequences, so those that share a path are neighbours
    and a node is what they share beyond their parent.
    """
    rows = sorted(rows, key=lambda r: sets[r].astype(">u8").tobytes())
    shared = [0]
    for a, b in zip(rows, rows[1:]):
        x, y = sets[a], sets[b]
        m = min(len(x), len(y))
        d = np.flatnonzero(x[:m] != y[:m])
        shared.append(int(d[0]) if len(d) else m)
    nodes: list = []

    def build(i: int, j: int, depth: int) -> None:
        stack = [(i, j, depth, None)]
        while stack:
            i, j, depth, close = stack.pop()
            if close is not None:
                nodes[close][5] = len(nodes)
                continue
            first = sets[rows[i]]
            common = min([len(first), *shared[i + 1:j]])
            k = i
            ending = []
            while k < j and len(sets[rows[k]]) == common:
                ending.append(rows[k])
                k += 1
            sizes = [len(sets[r]) for r in rows[i:j]]
            nodes.append([first[depth:common], ending, min(sizes), max(sizes), depth, None])
            stack.append((0, 0, 0, len(nodes) - 1))
            cuts = [k, *(c for c in range(k + 1, j) if shared[c] == common), j]
            for a, b in reversed(list(zip(cuts, cuts[1:]))):
                if a < b:
                    stack.append((a, b, common, None))

    # roots: runs of sets that share their first shingle
    cuts = [0, *(c for c in range(1, len(rows)) if shared[c] == 0), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            build(a, b, 0)
    return nodes


def trie_links(sets: list[np.ndarray], stored: list[int], probes: list[int], same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(stored, probe) with 100 * intersection >= 75 * union; sets are distinct, in the global order and not empty.

    same: a label for each set; sets of one label are known to be connected and aren't reported.
    """
    if not stored or not probes:
        return []
    flat = np.concatenate([sets[r] for r in probes])
    owner = np.repeat(np.arange(len(probes)), [len(sets[r]) for r in probes])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(sets[r]) for r in probes])
    # for the number of a probe's shingles up to some point of the order
    by_owner = [sets[r] for r in probes]
    nodes = _trie(sets, stored)
    links = []
    path: list[tuple[int, np.ndarray, np.ndarray]] = []  # (node after the subtree, overlap of each probe, probes still in)
    everyone = np.arange(len(probes))
    k = 0
    while k < len(nodes):
        shingles, ending, least, largest, depth, after = nodes[k]
        while path and path[-1][0] <= k:
            path.pop()
        overlap, active = (path[-1][1], path[-1][2]) if path else (np.zeros(len(probes), np.int64), everyone)
        a = np.searchsorted(flat, shingles, "left")
        b = np.searchsorted(flat, shingles, "right")
        hits = b - a
        if hits.any():
            at = np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
            overlap = overlap + np.bincount(owner[at], minlength=len(probes))
        deep = depth + len(shingles)
        for r in ending:
            union = size[active] + deep - overlap[active]
            for p in active[100 * overlap[active] >= 75 * union].tolist():
                if same is None or same[r] != same[probes[p]]:
                    links.append((r, probes[p]))
        if after > k + 1:
            # the largest overlap with a set below is reached at the size nearest to depth + what remains of the probe
            left = np.fromiter((size[p] - np.searchsorted(by_owner[p], shingles[-1], "right") if len(shingles) else size[p] for p in active.tolist()), np.int64, len(active))
            n = np.clip(deep + left, least, largest)
            bound = overlap[active] + np.minimum(n - deep, left)
            ok = 7 * bound >= 3 * (size[active] + n)
            still = active[ok]
            if not len(still):
                k = after
                continue
            path.append((after, overlap, still))
        k += 1
    return links


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _join_block(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of a block that connect: as many as a spanning forest has, at most."""
    sid = t["sid"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
    probe = t["probe"].to_numpy(zero_copy_only=False)
    rows = np.arange(len(sets))
    stored = rows[~probe].tolist()
    probes = rows[probe].tolist() if probe.any() else stored
    parent = list(range(len(sets)))
    a, b = [], []
    for x, y in trie_links(sets, stored, probes):
        i, j = _find(parent, x), _find(parent, y)
        if i != j:
            parent[i] = j
            a.append(int(sid[x]))
            b.append(int(sid[y]))
    if a:
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def _links(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """tasks: g, part, sid, probe. Joins the sets on and runs each (g, part) through _join_block."""
    return grouped(tasks.join(sets, "sid").select("g", "part", "sid", "probe", "shingles"), ["g", "part"], _join_block, "a long, b long")


# ---- sets at a common shingle ----


def _differences(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits by which row i of x and row j of y differ."""
    step = max(1, (1 << 21) // x.shape[1])
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(x[i[k:k + step]] ^ y[j[k:k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step))])


def _allowed(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows whose labels differ and whose bitmaps allow a link, and by how many shingles they likely differ; rows of two blocks, or of one."""
    n, hi, label, block = (t[c].to_numpy() for c in ("n", "hi", "label", "block"))
    raw = t["bits"].to_pylist()
    width = np.array([len(b) for b in raw])
    one = len(np.unique(block)) == 1
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join(raw[r] for r in rows), np.uint64).reshape(len(rows), -1)
        # a link's sizes differ by a third at most, and so do the widths by one step
        for wide in (w, 2 * w):
            others = rows if wide == w else np.flatnonzero(width == wide)
            if not len(others):
                continue
            y = x
            if wide != w:
                y = np.frombuffer(b"".join(raw[r] for r in others), np.uint64).reshape(len(others), -1)
                y = y[:, :x.shape[1]] ^ y[:, x.shape[1]:]
            step = max(1, (1 << 20) // len(others))
            for k in range(0, len(rows), step):
                a = rows[k:k + step, None]
                ok = (label[a] != label[others]) & (n[others] <= hi[a]) & (n[a] <= hi[others])
                if wide == w:
                    ok &= a < others
                if not one:
                    ok &= block[a] != block[others]
                i, j = np.nonzero(ok)
                apart = _differences(x, y, i + k, j)
                near = 7 * apart <= n[rows[i + k]] + n[others[j]]
                # differences that fall into one cell cancel out
                yield rows[i[near] + k], others[j[near]], -4 * w * np.log1p(-np.minimum(apart[near] / (4 * w), 0.999))


def _by_bitmaps(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(g, sid, n) of sets whose bitmaps allow a link with a set of the larger component g."""
    sid, n, label, members = (t[c].to_numpy() for c in ("sid", "n", "label", "members"))
    found = [np.zeros((0, 3), np.int64)]
    for i, j, _ in _allowed(t):
        larger = (members[i] > members[j]) | (members[i] == members[j]) & (label[i] > label[j])
        g, p = np.where(larger, i, j), np.where(larger, j, i)
        found.append(np.unique(np.stack([label[g], sid[p], n[p]], 1), axis=0))
    out = np.unique(np.concatenate(found), axis=0)
    if len(out):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T.copy()], ["g", "sid", "n"])


def _span(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (a, b), the best first, of a spanning forest of what part (a name for each node) doesn't connect yet; part then connects them."""
    kept = []
    at = np.arange(len(a))
    while len(at := at[part[a[at]] != part[b[at]]]):
        x, y = part[a[at]], part[b[at]]
        best = np.full(len(part), len(at))
        np.minimum.at(best, x, np.arange(len(at)))
        np.minimum.at(best, y, np.arange(len(at)))
        own = np.flatnonzero(best < len(at))
        e = best[own]
        kept.append(at[np.unique(e)])
        to = np.arange(len(part))
        to[own] = x[e] + y[e] - own
        back = to[to] == np.arange(len(to))  # two that chose the same edge
        to = np.where(back, np.minimum(to, np.arange(len(to))), to)
        while (to != to[to]).any():
            to = to[to]
        part[:] = to[part]
    return np.concatenate(kept) if kept else at


def _forest(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(g, sid, n): pairs of sets that likely link, fewer than there are components at the shingle."""
    sid, n = t["sid"].to_numpy(), t["n"].to_numpy()
    names, label = np.unique(t["label"].to_numpy(), return_inverse=True)
    part = np.arange(len(names))
    for i, j, apart in _allowed(t):
        share = apart / (n[i] + n[j])
        o = np.flatnonzero(7 * share <= 1)
        o = o[np.lexsort((sid[j[o]], sid[i[o]], share[o]))]
        e = o[_span(part, label[i[o]], label[j[o]])]
        if len(e):
            first = sid[i[e]] < sid[j[e]]
            g, p = np.where(first, i[e], j[e]), np.where(first, j[e], i[e])
            yield pa.RecordBatch.from_arrays([pa.array(sid[g]), pa.array(sid[p]), pa.array(n[p])], ["g", "sid", "n"])


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(sid, bits) of sets (sid, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array([bitmap(np.frombuffer(x, np.uint64)) for x in b.column("shingles").to_pylist()], pa.binary())], ["sid", "bits"])

    return sets.mapInArrow(run, "sid long, bits binary")


def _meet_at_hot(hot: DataFrame, bits: DataFrame, fn) -> DataFrame:
    """(g, sid, n): what fn finds among the rows (token, sid, n, hi, label, ...) at each shingle of many sets.

    Every two sets at a shingle are compared by their bitmaps, in blocks of bounded size: a link isn't ruled out.
    """
    rows = hot.join(bits, "sid")
    size = hot.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.least(F.lit(MOST_BITS / 8), F.greatest(F.lit(LEAST_BITS / 8), F.col("n") / 2))).alias("s"))
    blocks = size.select("token", F.greatest(F.ceil(F.col("c") / HOT_BLOCK), F.ceil(F.col("s") / HOT_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    return grouped(rows.select("token", "part", "block", *(c for c in hot.columns if c != "token"), "bits"), ["token", "part"], fn, "g long, sid long, n long")


# ---- the join ----


def _blocks(members: DataFrame, g: str) -> DataFrame:
    """(g, blocks): the number of blocks for each group's sets."""
    return members.groupBy(g).agg(F.count("*").alias("c"), F.sum("n").alias("s")).select(
        g, F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _around(hubs: DataFrame) -> DataFrame:
    """(g, part, sid): the blocks of the sets of hubs (sid, n, g), each with the set g."""
    blocks = _blocks(hubs, "g")
    return spread_join(hubs, blocks, "g", "sid").select("g", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("part"), "sid").union(
        blocks.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("g").alias("sid")))


def _still_open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Of rows (token, sid, n, hi) those at shingles where different components may link, with their component as label."""
    label = rows.join(parts, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "hi", F.coalesce("component", "sid").alias("label"))
    several = label.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least_n"), F.max("hi").alias("most_hi")).where("x != y").drop("x", "y")
    return label.join(several, "token").where("least_n <= hi AND n <= most_hi").select("token", "sid", "n", "hi", "label")


def _hot_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT_SETS).select("token")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart even where doc_ids are null or repeat; repeated rows share it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reached over links.

    Documents link where their sets of lower-cased (A-Z) 5-word shingles have a
    Jaccard similarity of 0.75 or more; fewer words are one shingle. Null texts and
    texts without words have no shingles and are their own component. Repeated rows
    come back as often as they come. A null doc_id comes last: the component_id is null
    only where no document of the component has a doc_id. An empty table gives no rows.
    """
    whole = _labelled(docs, doc_id, text)
    least = whole.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return spread_join(whole, least, "label", "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): the row_key of one row of each component, that with the least doc_id (null last), and of each text without words."""
    whole = _labelled(docs, doc_id, text)
    least = whole.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("f"))
    return least.select("f.key").union(whole.where("label IS NULL").select("key")).distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n, label) of each row: number of shingles, and a name of its component, null without shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    both = scratch.cut(_summaries(docs))
    known = both.where("kind = 0").select("doc_id", "key", "n", "sid", "alt")
    # of sets whose first halves are equal by chance all but one go by their second: at 10**9 sets there is hardly one
    clash = known.where("sid IS NOT NULL").groupBy("sid").agg(F.min("alt").alias("x"), F.max("alt").alias("y")).where("x != y").collect()
    for r in clash:
        known = known.withColumn("sid", F.when((F.col("sid") == r["sid"]) & (F.col("alt") != r["x"]), F.col("alt")).otherwise(F.col("sid")))
    second = {r["sid"]: r["x"] for r in clash}
    shingles = known.agg(F.sum("n")).first()[0] or 0
    common = spark.sparkContext.broadcast(_common_cells(both.where("kind = 1"), shingles))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task give their prefix once
        for batch in (p for b in batches for p in slices(b, "text")):
            tokens, sids, sizes = [], [], []
            for s in shingle_sets(batch.column("text")):
                if len(s) and (i := set_id(s, second)) not in seen:
                    seen.add(i)
                    n = len(s)
                    p = ordered(s, common.value)[:prefix_length(n)].view(np.int64)
                    tokens.append(p)
                    sids.append(np.full(len(p), i))
                    # a set that this one links with and shares at most n // SLACK shingles before place i with has no more shingles than this
                    sizes.append((n << 32) + 7 * (n - np.arange(len(p)) + n // SLACK) // 3 - n)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sizes, sids)], ["token", "size", "sid"])

    met = meeting(docs.select("text").mapInArrow(prefixes, "token long, size long, sid long"), "size")
    met = scratch.cut(met.select("token", "sid", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND((1 << 32) - 1).alias("hi"), "lo"))

    # 1. blocks around the set that a set shares most of its prefix with: the smallest one at a shingle
    p = F.expr("n - (3 * n + 3) DIV 4 + 1")
    hubs = met.where("sid != lo").groupBy("sid", "n", "lo").agg(F.count("*").alias("c")).where(3 * F.col("c") >= p)
    hubs = hubs.groupBy("sid", "n").agg(F.max_by("lo", F.struct("c", "lo")).alias("g"))
    hubs = scratch.cut(hubs)
    tasks = _around(hubs)
    sets = scratch.cut(_sets_of(docs, known, tasks.select("sid"), common, second))
    links = scratch.cut(_links(tasks.withColumn("probe", F.lit(False)), sets))
    scratch.drop(sets)
    parts = scratch.cut(connected_components(links, scratch))

    # 2. components that still meet at prefix shingles
    open_ = scratch.cut(_still_open(met.drop("lo"), parts))
    scratch.drop(met)
    hot = scratch.cut(open_.join(_hot_tokens(open_), "token", "left_semi"))
    sets = scratch.cut(_sets_of(docs, known, hot.select("sid"), common, second))
    bits = scratch.cut(_bitmaps(sets))
    pairs = scratch.cut(_meet_at_hot(hot, bits, _forest).distinct())
    links = scratch.cut(links.union(_links(_around(pairs).withColumn("probe", F.lit(False)), sets)))
    scratch.drop(hot, sets)
    parts = scratch.cut(connected_components(links, scratch))
    open_ = scratch.cut(_still_open(open_.drop("label"), parts))
    members = open_.select("sid", "n", "label").distinct()
    about = scratch.cut(members.groupBy("label").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("largest")))
    many = scratch.cut(_hot_tokens(open_))
    few = open_.join(many, "token", "left_anti")
    at = few.groupBy("token", "label").agg(F.min("n").alias("least_n"), F.max("hi").alias("most_hi"))
    at = spread_join(at, about, "label", "token").select("token", F.col("label").alias("g"), F.col("members").alias("g_members"), "least", "largest", "least_n", "most_hi")
    mine = spread_join(few, about.select("label", "members"), "label", "sid")
    hot = scratch.cut(spread_join(open_.join(many, "token", "left_semi"), about.select("label", "members"), "label", "sid"))
    # of two components, the larger is stored and the sets of the other are probes
    bounds = (F.col("least_n") <= F.col("hi")) & (F.col("n") <= F.col("most_hi"))
    meet = mine.join(at, "token").where(bounds & (F.struct("g_members", "g") > F.struct("members", "label"))).groupBy("g", "sid", "n", "least", "largest").agg(F.count("*").alias("c"))
    # sizes within the threshold, and the prefix shingles that two linked sets share at least
    lo, hi = F.greatest("least", F.ceil(F.col("n") * 3 / 4)), F.least("largest", F.floor(F.col("n") * 4 / 3))
    need = lambda m: F.ceil((F.col("n") + m) * 3 / 7) - F.greatest(F.expr("(3 * n + 3) DIV 4"), F.floor((3 * m + 3) / 4)) + 1
    # need rises with m up to n and falls beyond it, but for rounding: its least is at lo or in the last four sizes
    least_need = F.least(need(lo), *(need(F.greatest(lo, hi - k)) for k in range(4)))
    # of these the first n // SLACK + 1 are met for sure, and n / SLACK for a set of three quarters of the size
    least_need = F.least(least_need, F.floor(F.col("n") * 3 / 4 / SLACK) + 1)
    # where one of these is a shingle of many sets the bitmaps meet there, else all of them count here
    meet = meet.where(lo <= hi).where(F.col("c") >= least_need).select("g", "sid", "n")
    meet = scratch.cut(meet.union(_meet_at_hot(hot, bits, _by_bitmaps)).distinct())
    stored = scratch.cut(spread_join(members, meet.select(F.col("g").alias("label")).distinct(), "label", "sid").select(F.col("label").alias("g"), "sid", "n"))
    rows, columns = _blocks(stored, "g"), _blocks(meet, "g").withColumnRenamed("blocks", "columns")
    grid = scratch.cut(rows.join(columns, "g"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    tasks = spread_join(stored, grid, "g", "sid").withColumn("row", F.pmod(F.xxhash64("sid"), "blocks")).withColumn("column", spread("columns")).withColumn("probe", F.lit(False)).select("g", "columns", "row", "column", "sid", "probe").union(
        spread_join(meet, grid, "g", "sid").withColumn("column", F.pmod(F.xxhash64("sid"), "columns")).withColumn("row", spread("blocks")).withColumn("probe", F.lit(True)).select("g", "columns", "row", "column", "sid", "probe"))
    tasks = tasks.select("g", (F.col("row") * F.col("columns") + F.col("column")).cast("int").alias("part"), "sid", "probe")
    sets = scratch.cut(_sets_of(docs, known, meet.select("sid").union(stored.select("sid")), common, second))
    more = scratch.cut(_links(tasks, sets))
    scratch.drop(sets, open_, hot)
    parts = connected_components(links.union(more), scratch)

    # back to documents
    whole = known.join(parts, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "sid"))
    return scratch.cut(whole.select("doc_id", "key", "n", "label"))


def _sets_of(docs: DataFrame, known: DataFrame, wanted: DataFrame, common, second: dict[int, int]) -> DataFrame:
    """(sid, shingles) in the global order of the wanted sids, each from the document with the least key that has it.

    A filter of those keys keeps other documents from being cut into shingles again;
    the join keeps what it lets through in vain out.
    """
    first = known.groupBy("sid").agg(F.min("key").alias("key")).join(wanted.distinct(), "sid")
    cells, cell = filter_of(first, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: set[tuple[int, int]] = set()  # by key too: a copy that the filter lets through in vain doesn't stand for the wanted one
        for batch in batches:
            hit = cells.value.has(batch.column("cell").to_numpy())
            keys = batch.column("key").to_numpy()
            at = np.flatnonzero(hit)
            out, held = [], 0
            for i, s in zip(at.tolist(), shingle_sets(batch.column("text").take(pa.array(at)))):
                if len(s) and (row := (int(keys[i]), set_id(s, second))) not in got:
                    got.add(row)
                    out.append((*row, ordered(s, common.value).tobytes()))
                    held += s.nbytes
                if held > 8 << 20:
                    yield rows_of(out)
                    out, held = [], 0
            if out:
                yield rows_of(out)

    def rows_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["key", "sid", "shingles"])

    rows = docs.select("text", "key", cell.alias("cell")).mapInArrow(run, "key long, sid long, shingles binary")
    return rows.join(first, ["key", "sid"], "left_semi").dropDuplicates(["sid"]).select("sid", "shingles")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A null or empty text has no shingles and is its own component. Repeated rows come
    back as often as they come; a null doc_id comes back null, with the component_id
    of its component, null where no document of it has a doc_id. Of ties the smallest
    doc_id names the component. Texts are read whole, other columns ignored. No rows
    give no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))
