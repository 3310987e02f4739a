"""Rules that size an index and a search. Constants are fixed values that results depend on."""

from __future__ import annotations

import math

# Fixed values.
PAGE_BYTES = 8192
PAGE_HEADER_BYTES = 24
PAGE_TRAILER_BYTES = 40
ENTRY_HEADER_BYTES = 20
DEFAULT_TARGET_PAGES = 3
MIN_ENTRIES_PER_LIST = 256
DEFAULT_FAN_OUT = 32
MAX_NLIST = 2_000_000
MAX_NPROBE = 10_000
FILTER_SIGMAS = 3.0
FILTER_MIN_SELECTIVITY = 1e-4
POOL_COEFFICIENT = 3.0
POOL_EXPONENT = 0.15
BEAM_FLOOR = 80
PROBE_EXPAND_MOST = 256
LEAST_TOP_K = 10


def entry_bytes(dim: int) -> int:
    """A posting: header and one bit a dimension, in whole words of 4 bytes."""
    return -(-(ENTRY_HEADER_BYTES + -(-dim // 8)) // 4) * 4


def target_entries(dim: int, target_pages: int = 0) -> int:
    """Entries that a posting list is meant to hold."""
    usable = PAGE_BYTES - PAGE_HEADER_BYTES - PAGE_TRAILER_BYTES
    return max(max(1, usable // entry_bytes(dim)) * (target_pages or DEFAULT_TARGET_PAGES), MIN_ENTRIES_PER_LIST)


def auto_nlist(rows: int, dim: int, target_pages: int = 0) -> int:
    """Posting lists: by the target, but the square root of the rows at least."""
    c = max(rows, 1)
    return min(MAX_NLIST, max(int(c / target_entries(dim, target_pages) + 0.5), math.isqrt(c), 1))


def auto_fan_out(nlist: int, fan_out: int = DEFAULT_FAN_OUT) -> int:
    """Children of a node: a given number, else the square root of nlist, or the cube root if that is over 256."""
    if nlist <= fan_out:
        return nlist
    if fan_out != DEFAULT_FAN_OUT:
        return fan_out
    f = math.ceil(math.sqrt(nlist))
    return math.ceil(round(nlist ** (1 / 3), 9)) if f > 256 else f


def tree_levels(nlist: int, fan_out: int) -> int:
    if nlist <= fan_out or fan_out < 2:
        return 1
    return math.ceil(round(math.log(nlist) / math.log(fan_out), 9))


def auto_nprobe(nlist: int) -> int:
    """Lists to read: half the square root of nlist, 10 to 2048."""
    return min(nlist, max(10, min(2048, math.ceil(0.5 * math.sqrt(nlist)))))


def beam_width(nprobe: int, nlist: int, fan_out: int, beam_scale: float = 0.5) -> int:
    """Nodes kept on each inner level of the tree."""
    w = max(1, int(nprobe * beam_scale), min(nprobe, BEAM_FLOOR), -(-nprobe // fan_out) if fan_out else 1)
    return max(w, nprobe) if nlist and nprobe >= nlist else w


def routed_clusters(nprobe: int, cap: int, compressed: bool, expand: float = 2.0) -> int:
    """Clusters to rank exactly when routing used compressed centroids."""
    if expand <= 1 or not compressed:
        return nprobe
    return max(nprobe, min(int(nprobe * expand + 0.5), nprobe + PROBE_EXPAND_MOST, cap))


def rerank_pool(k: int, nprobe: int, setting: int = 0, candidates: int = 0) -> int | None:
    """Candidates to rank exactly: all (None) for -1, a given number, else by k and nprobe or an eighth of the candidates."""
    if setting < 0:
        return None
    if setting > 0:
        return max(k, setting)
    return max(k, int(POOL_COEFFICIENT * k * nprobe**POOL_EXPONENT + 0.5), candidates // 8)


def inflate_for_filter(k: int, selectivity: float) -> int:
    """Neighbours to find so that about k are left once a filter is applied to them."""
    if k == 0 or not math.isfinite(selectivity) or not 0 < selectivity < 1:
        return k
    return max(k, math.ceil((1 + FILTER_SIGMAS / math.sqrt(k)) * k / max(selectivity, FILTER_MIN_SELECTIVITY)))


def top_k(limit: int | None, rows: int, offset: int = 0, query_limit: int = 0) -> int:
    """Neighbours that a scan finds for LIMIT and OFFSET: 10 at least, all rows without LIMIT; query_limit only lowers."""
    k = rows if limit is None else limit + offset
    if query_limit > 0:
        k = min(k, query_limit)
    return max(k, LEAST_TOP_K)
