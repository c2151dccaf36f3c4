"""Words and their 64-bit hashes, computed with numpy on the bytes of Arrow string columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``). In UTF-8 no multi-byte character holds such a byte, so the
words of the bytes are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE_BYTE, _BASE_WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..base**n and their inverses, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 2)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 8 * BLOCK_BYTES:
            return made
        _powers[base] = made
    return _powers[base]


def span_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span: equal contents give equal hashes wherever they stand."""
    up, down = _power(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


@dataclass
class Block:
    """Some whole documents: rows first..first+n of a batch; word i spans bytes start[i]:end[i]; document k has words bound[k]:bound[k+1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One hash per word; with ``lower``, of the word with A-Z lower-cased."""
        return span_hashes(_BYTE_VALUE[_LOWER[self.data] if lower else self.data], _BASE_BYTE, self.start, self.end)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for every i, also where that crosses documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return span_hashes(words, _BASE_WORD, at, at + n)


def _views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string column in blocks of about ``block_bytes``; null counts as empty."""
    data, at = _views(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + block_bytes, "right")) - 1)
        yield block_of(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def block_of(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Block:
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | cut[:-1]))
    end = np.flatnonzero(~space & (after | cut[1:])) + 1
    return Block(first, data, offsets, start, end, np.searchsorted(start, offsets))


def i64(x: np.ndarray) -> np.ndarray:
    """The same 64 bits, signed, as Spark's bigint has them."""
    return x.view(np.int64)
