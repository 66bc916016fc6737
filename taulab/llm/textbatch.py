"""Vectorised tokenisation of Arrow string columns with numpy.

A batch of texts is looked at as one byte buffer with row offsets.  Words are
maximal runs of "word bytes" inside one row; each gets a 64-bit hash.  All work
on bytes is done in bounded pieces, so that a very long text costs memory in
proportion to its number of words and not to 8 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
CHUNK_BYTES = 4 << 20

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix_scalar(x: int) -> int:
    x &= (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_values(lower: bool) -> np.ndarray:
    """A random odd 64-bit value for each byte; A-Z count as a-z if lower."""
    t = np.array([_mix_scalar(b + 1) | 1 for b in range(256)], dtype=_U)
    if lower:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that are outside all the given inclusive ranges."""
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Word bytes of ``[^\x20\x09-\x0D]+``; every byte of a longer UTF-8 sequence is one.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
FOLDED = byte_values(True)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, PIECE_BYTES + 4096)
            with np.errstate(over="ignore"):
                step, back = np.full(m, _MULTIPLIER, dtype=_U), np.full(m, pow(_MULTIPLIER, -1, 1 << 64), dtype=_U)
                step[0] = back[0] = 1
                self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up, self.down


_POWERS = _Powers()


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for pieces of about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
        yield i, j, buf[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all); words never cross rows."""
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    w = is_word[buf]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = w[0], w[-1]
    np.logical_xor(w[1:], w[:-1], out=edge[1:n])
    inner = offs[(offs > 0) & (offs < n)]
    both = np.unique(inner[w[inner] & w[inner - 1]])
    at = np.flatnonzero(edge)
    if len(both):  # a word ends and another starts at a row's edge
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), dtype=_U)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
            s, e = starts[i], ends[j - 1]
            up, down = _POWERS.get(int(e - s))
            run = np.empty(e - s + 1, dtype=_U)
            run[0] = 0
            np.cumsum(values[buf[s:e]] * up[: e - s], out=run[1:])
            a = starts[i:j] - s
            out[i:j] = (run[ends[i:j] - s] - run[a]) * down[a]
            i = j
        return mix(out + (ends - starts).astype(_U))


_ODD = [_mix_scalar(1000 + i) | 1 for i in range(64)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width consecutive words; entry i is of the words from i on."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        acc = np.full(n, _mix_scalar(7000 + width), dtype=_U)
        for k in range(width):
            acc += words[k : k + n] * _U(_ODD[k])
        return mix(acc)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence of words that is shorter than a window."""
    return window_hashes(words, len(words))
