"""Vectorised reading of text columns inside Arrow batches.

A text column is looked at as one array of UTF-8 bytes. Words are maximal runs
of bytes outside a separator table, cut at document borders; a word's 64-bit
hash is a difference of prefix sums, so hashing costs a few array passes and no
Python object per word. Chunks bound the memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, read after lower-casing A-Z.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
PUNCT[65:91] = False
#: UTF-8 bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), U(_ODD if kind == "up" else _INV))
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins (nulls are empty), the end last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of a range of rows: byte bounds, row of each, first word of each row (end last)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Words:
    inside = ~separators[raw]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; with lower, as if A-Z were a-z."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[raw] * _power("up", n)[:n], out=sums[1:])
    out = (sums[end] - sums[start]) * _power("down", n + 1)[start]
    return mix(out + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def windows(hashed: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words within a row; and its first word's index."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * U(_ODD) + hashed[i : n + i]
    keep = np.flatnonzero(_same_row(first, n, k))
    return mix(total[keep] + U(k)), keep


def _same_row(first: np.ndarray, n: int, k: int) -> np.ndarray:
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:n] == row[k - 1 : n + k - 1]


def shingles(hashed: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the row of each: every k words; a row of fewer words, but not none, is one shingle."""
    h, at = windows(hashed, first, k)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            x = 0
            for w in hashed[first[r] : first[r + 1]].tolist():
                x = (x * _ODD + w) & ((1 << 64) - 1)
            extra[i] = x
        h = np.concatenate([h, mix(extra + size[short].astype(np.uint64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
