"""Vectorised word splitting and hashing over Arrow batches, shared by the text operators.

Texts are handled as one concatenated UTF-8 buffer.  Every separator class used here is ASCII only,
so a 256-entry byte table decides word membership and multi-byte characters stay inside their word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a single longer document makes its own pass.
CHUNK_BYTES = 2 << 20
#: The same for passes that make some twenty arrays of a word for each byte; small ones also stay in the processor's cache.
PASS_BYTES = 256 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)


def _class_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words are runs of bytes other than ASCII white space.
NON_SPACE = _class_table(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = ((n >> 16) + 2) << 16
            up, down = np.full(size, _MULT), np.full(size, _INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def row_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most `limit` bytes together (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): all texts, nulls as empty, each followed by one newline byte."""
    if not pa.types.is_string(texts.type) and not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, count=n + 1, offset=4 * texts.offset).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    if inside[-1]:
        edges = np.r_[edges, len(data)]
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    up, down = _POWERS.to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the documents in it)."""
    data, offsets = joined(texts)
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, table)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of `n` words; windows may cross documents, so callers cut them."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * _MULT + words[i : i + len(out)])
    return out


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For row counts, (row of each element, index of the element in its row)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
