"""Minimal perfect hash over 64-bit keys: levels of bit arrays, ranks by prefix counts, stored fingerprints."""

from __future__ import annotations

import struct

import numpy as np

from .text import mix

GAMMA, MAX_LEVELS = 2.0, 64
_HEAD = struct.Struct("<4sII")


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys ^ mix(np.full(1, level * 2 + 1, np.uint64))) % np.uint64(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """slot(key) is a distinct number under len(keys) for each of the keys it was built from.

    A key stands at the first level whose bit no other remaining key asks for; its slot is the number of set bits before.
    Expected work per key is constant for building and for lookup.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.rank = np.cumsum(flat) - flat
        self.base = np.cumsum([0, *(len(x) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys must be distinct."""
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            bits = max(8, int(GAMMA * len(left)))
            at = _place(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of known keys; for others some slot or -1, which the fingerprint tells apart."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, alone in enumerate(self.levels):
            at = _place(keys[left], k, len(alone)).astype(np.int64)
            here = alone[at]
            out[left[here]] = self.rank[self.base[k] + at[here]]
            left = left[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], "<u8").tobytes()
        packed = b"".join(np.packbits(x, bitorder="little").tobytes() for x in self.levels)
        return _HEAD.pack(b"MPH1", len(self.levels), len(packed)) + sizes + packed

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        magic, n, size = _HEAD.unpack_from(data)
        if magic != b"MPH1":
            raise ValueError("not a hash index")
        sizes = np.frombuffer(data, "<u8", n, _HEAD.size).astype(np.int64)
        at, levels = _HEAD.size + 8 * n, []
        for bits in sizes:
            nbytes = (int(bits) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, nbytes, at), count=int(bits), bitorder="little").astype(bool))
            at += nbytes
        return cls(levels)
