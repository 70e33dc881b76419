"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes, over shards of byte strings."""

from __future__ import annotations

import numpy as np

#: Bytes are symbols 1 to 256; 0 ends each string and differs from every byte.  So many symbols fit into a word.
_PACKED = 7


def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all parts, each followed by 0; where each part begins)."""
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    out = np.zeros(int(lengths.sum()) + len(parts), np.uint16)
    inside = np.ones(len(out), bool)
    inside[begins + lengths] = False
    out[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    return out, begins


def _sorted_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys); keys that leave `bits` bits free carry their place, which sorts without indirection."""
    if len(keys) and int(keys.max()) >> (64 - bits):
        order = np.argsort(keys)
        return order, keys[order]
    both = np.sort((keys << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    The first sort takes a few symbols packed into a word.  Then groups that are still equal are sorted by the rank of
    the suffix h symbols on, h doubling each time; sorted suffixes are not touched again.
    """
    n = len(sym)
    bits = max(1, n.bit_length())
    padded = np.zeros(n + _PACKED, np.uint64)
    padded[:n] = sym
    key = np.zeros(n, np.uint64)
    h = min(_PACKED, max(1, (64 - bits) // 9))
    for k in range(h):
        key = (key << np.uint64(9)) | padded[k : k + n]
    sa, ordered = _sorted_places(key, bits)
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.zeros(2 * n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    live = np.flatnonzero(~first | ~np.r_[first[1:], True])
    while len(live):
        at = sa[live]
        order, key = _sorted_places((rank[at].astype(np.uint64) << np.uint64(bits)) | rank[np.minimum(at + h, 2 * n)].astype(np.uint64), len(live).bit_length() if 3 * bits <= 64 else bits)
        at = at[order]
        sa[live] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))] + 1
        live = live[~new | ~np.r_[new[1:], True]]
        h *= 2
    return sa


def common_prefixes(sym: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """lcp[i]: equal leading symbols of suffix i and the one before it in `sa`, counted up to `most`.

    By Kasai, lcp[i + d] >= lcp[i] - d.  Positions are taken in rounds, every 16th first and then those half way
    between, each beginning from that bound, and are compared four symbols at a time.
    """
    n = len(sym)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 8, np.uint64)
    padded[:n] = sym
    words = padded[:-3] | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(32)) | (padded[3:] << np.uint64(48))
    lcp = np.zeros(n, np.int64)
    for begin, step in ((0, 16), (8, 16), (4, 8), (2, 4), (1, 2)):
        i = np.arange(begin, n, step)
        if begin:
            lcp[i] = np.maximum(lcp[i - begin] - begin, 0)
        i = i[(before[i] >= 0) & (lcp[i] < most)]
        while len(i):
            differ = words[i + lcp[i]] ^ words[before[i] + lcp[i]]
            same = differ == 0
            rest = i[~same]
            lcp[rest] += np.bitwise_count((differ[~same] & (~differ[~same] + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 16
            i = i[same]
            lcp[i] += 4
            i = i[(lcp[i] < most) & (np.maximum(i, before[i]) + lcp[i] < n)]
    return np.minimum(lcp, most)


def repeated(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flags, begins, order): a flag for each symbol where a string of `width` bytes starts that starts twice in `parts`.

    `begins` has each part's first position, `order` the starts of whole strings in suffix order.
    """
    sym, begins = symbols(parts)
    sa = suffix_array(sym)
    lcp = common_prefixes(sym, sa, width)
    flags = lcp >= width
    flags[sa[:-1]] |= lcp[sa[1:]] >= width
    return flags, begins, sa
