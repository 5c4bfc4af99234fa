"""Elias-Fano code of a non-decreasing sequence, with select by sampled positions."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sQQB")
_BLOCK = 64  # bytes of the upper bits under one directory entry


class EliasFano:
    """``n`` numbers up to ``universe`` in about ``2 + log2(universe / n)`` bits each.

    The low bits are packed side by side; the upper bits are unary in a bit vector.  A directory of one 32-bit count
    per 512 upper bits makes ``select`` a binary search and one block's scan.
    """

    def __init__(self, n: int, universe: int, low_width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_width, self.low, self.high = n, universe, low_width, low, high
        pad = -len(high) % _BLOCK
        ones = np.bitwise_count(np.concatenate([high, np.zeros(pad, np.uint8)])).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        width = max(0, int(universe // max(1, n)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if width and n:
            bits = (values[:, None] >> np.arange(width)) & 1
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        marks = np.zeros(n + (universe >> width) + 1, np.uint8)
        marks[(values >> width) + np.arange(n)] = 1
        return cls(n, universe, width, low, np.packbits(marks, bitorder="little"))

    def select(self, i: int) -> int:
        """The ``i``-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.directory, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _BLOCK : (block + 1) * _BLOCK], bitorder="little")
        at = int(np.flatnonzero(bits)[i - int(self.directory[block])]) + block * _BLOCK * 8
        first = i * self.low_width
        part = np.unpackbits(self.low[first // 8 : (first + self.low_width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_width]
        return ((at - i) << self.low_width) | int(sum(int(b) << k for k, b in enumerate(part)))

    def window(self, start: int, count: int) -> np.ndarray:
        """Numbers ``start`` to ``start + count - 1``, decoded together."""
        count = min(count, self.n - start)
        if count <= 0:
            return np.zeros(0, np.int64)
        block = int(np.searchsorted(self.directory, start, side="right")) - 1
        last = int(np.searchsorted(self.directory, start + count - 1, side="right"))
        at = np.flatnonzero(np.unpackbits(self.high[block * _BLOCK : last * _BLOCK], bitorder="little"))
        skip = start - int(self.directory[block])
        at = at[skip : skip + count] + block * _BLOCK * 8
        out = (at - np.arange(start, start + count)) << self.low_width
        if self.low_width:
            first = start * self.low_width
            end = first + count * self.low_width
            bits = np.unpackbits(self.low[first // 8 : (end + 7) // 8], bitorder="little")[first % 8 : first % 8 + count * self.low_width]
            out |= bits.reshape(count, self.low_width).astype(np.int64) @ (1 << np.arange(self.low_width, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return _HEAD.pack(b"EF01", self.n, self.universe, self.low_width) + struct.pack("<Q", len(self.low)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        mark, n, universe, width = _HEAD.unpack_from(raw)
        if mark != b"EF01":
            raise ValueError("not an Elias-Fano block")
        (size,) = struct.unpack_from("<Q", raw, _HEAD.size)
        body = np.frombuffer(raw, np.uint8, offset=_HEAD.size + 8)
        return cls(n, universe, width, body[:size], body[size:])
