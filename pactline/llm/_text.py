"""Vectorised word hashing of Arrow text batches, shared by the corpus operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never
occur inside a multi-byte UTF-8 character, so whole texts are cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATED = np.array([not chr(b).isalnum() for b in range(128)] + [False] * 128)
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over unsigned 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(name: str, base: U, n: int) -> np.ndarray:
    t = _powers.get(name)
    if t is None or len(t) < n:
        t = np.full(max(n, CHUNK_BYTES + 1), base, U)
        t[0] = 1
        t = _powers[name] = np.multiply.accumulate(t)
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of consecutive rows: hash, byte start and end, and the first word of each row."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, punctuation: bool = False):
        """fold: A-Z counts as a-z; punctuation: every ASCII byte but letters and digits parts words."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        b, edges = data[lo:hi], (offsets - lo).astype(np.int64)
        inside = np.empty(len(b) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not((_PUNCTUATED if punctuation else _SPACE)[b], out=inside[1:-1])
        start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = edges[(edges > 0) & (edges < len(b))]
        start[cuts] = inside[cuts + 1]  # a word never runs on into the next row
        end[cuts - 1] = inside[cuts]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        sums = np.zeros(len(b) + 1, U)
        np.cumsum((_FOLDED if fold else _BYTES)[b] * _table("up", _BASE, len(b) + 1)[: len(b)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _table("down", _INVERSE, len(b) + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, edges, side="left")
        self.start, self.end = self.start + lo, self.end + lo


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes (rows are not told apart here)."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    g = words[:m].copy()
    for i in range(1, n):
        g *= U(0xD6E8FEB86659FD93)
        g += words[i : i + m]
    return mix(g)


_ZSTD = pa.Codec("zstd", 1)


def pack(batches):
    """(doc_id, size, packed): texts compressed before a shuffle; a null text has size null."""
    for batch in batches:
        raw = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else len(t) for t in raw], pa.int64()), pa.array([None if t is None else _ZSTD.compress(t, asbytes=True) for t in raw], pa.binary())], ["doc_id", "size", "packed"])


def unpack(sizes: pa.Array, packed: pa.Array) -> list[bytes]:
    """The UTF-8 texts of packed rows; nulls are empty."""
    return [_ZSTD.decompress(p.as_buffer(), n, asbytes=True) if n else b"" for n, p in zip(sizes.to_pylist(), packed)]
