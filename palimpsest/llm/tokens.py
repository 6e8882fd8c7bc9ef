"""Vectorised tokenizing and rolling hashes over Arrow string columns.

A token is a maximal run of ASCII letters and digits (ASCII upper case folded) and of bytes of
non-ASCII characters; every other ASCII character separates. Whole Arrow buffers are processed at
once, so the cost is a few numpy passes per byte and no Python work per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled together; a longer document is a chunk by itself.
CHUNK = 1 << 20
#: The same token rule for SQL engines with RE2 expressions.
SQL_TOKENS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"

_BASE = U64(0x9E3779B97F4A7C15)
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b >= 128:
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: U64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown on demand)."""
    have = _POW.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 64)
        inv = U64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.concatenate([[U64(1)], np.full(size, base, U64)]).cumprod(dtype=U64)
            down = np.concatenate([[U64(1)], np.full(size, inv, U64)]).cumprod(dtype=U64)
        have = _POW[int(base)] = (up, down)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Chunk:
    """Tokens of the documents first..first+n of a batch.

    start/end: byte positions in the chunk; doc: document index in the chunk; at: first token of
    each document (n + 1 entries); hash: 64-bit token hashes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        folded = _FOLD[data]
        inside = folded != 0
        begin, finish = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            finish[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < len(data)]
            begin[edge] |= inside[edge]
            last = offsets[1:][offsets[1:] > 0] - 1
            finish[last] |= inside[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.at = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.at))
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(folded * up[: len(data)], dtype=U64, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self._sums, self._down = sums, down

    def beginnings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first k bytes of all tokens that have as many, and the tokens."""
        at = np.flatnonzero(self.end - self.start >= k)
        begin = self.start[at]
        return mix(((self._sums[begin + k] - self._sums[begin]) * self._down[begin] + U64(k)) ^ U64(0x6C62272E07BB0142)), at

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-token windows inside one document, and the token each starts at."""
        return windows(self.hash, self.doc, k)


def windows(tokens: np.ndarray, doc: np.ndarray, k: int, base: U64 = U64(0xC2B2AE3D27D4EB4F)) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k-token window that stays in its document, and its first token."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    up, down = powers(len(tokens) + 1, base)
    sums = np.zeros(len(tokens) + 1, U64)
    np.cumsum(tokens * up[: len(tokens)], dtype=U64, out=sums[1:])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix((sums[at + k] - sums[at]) * down[at]), at


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The documents of a column in chunks of about `limit` bytes, none of them cut."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
