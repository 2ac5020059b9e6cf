"""Vectorised text kernels over Arrow buffers.

Everything here works on the raw UTF-8 bytes of a whole Arrow string column at once (numpy, no
per-row Python): word boundaries, 64-bit word hashes, hashes of k consecutive words and sliding
minima. Hashes only ever *select* candidates or name words; operators that drop text compare the
text itself (windows of words that many documents have: a second, independent 64-bit hash of it) before acting.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
#: A second hash of words, independent of the first.
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P2 = 0xC2B2AE3D27D4EB4F | 1
_pow: dict[int, np.ndarray] = {}


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back to the system: workers live on after their task, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept per worker."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 12), base, dtype=U64)
        out[0] = 1
        _pow[base] = have = np.multiply.accumulate(out)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string/binary array; a null reads as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if "binary" in str(arr.type) else "")
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `col` holds about `limit` bytes in each (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        for i, j in spans(b.column(b.schema.get_field_index(col)), limit):
            yield b.slice(i, j - i)
        trim()


def spans(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an array that hold about `limit` bytes of text each (one row at least)."""
    _, off = buffers(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Normalised words: ASCII letters and digits and all non-ASCII bytes make up words.
NONWORD = np.ones(256, bool)
NONWORD[48:58] = NONWORD[97:123] = NONWORD[65:91] = NONWORD[128:] = False


def separators(data: np.ndarray, normalised: bool) -> np.ndarray:
    """True where a byte separates words. normalised: all ASCII but letters and digits, the no-break
    space and the general-punctuation block (U+2000..U+207F: dashes, quotes, ellipsis, thin spaces)."""
    if not normalised:
        return SPACE[data]
    sep = NONWORD[data]
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
        for k in range(3):
            sep[at + k] = True
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        for k in range(2):
            sep[at + k] = True
    return sep


def words(data: np.ndarray, off: np.ndarray, normalised: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words and, for each document, the number of its first
    word (one entry more than documents). Words never cross documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = ~separators(data, normalised)
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    start = w & brk[:n]
    start[1:] |= w[1:] & ~w[:-1]
    end = w & brk[1:]
    end[:-1] |= w[:-1] & ~w[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def symbols(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes only."""
    raw, seen = data.tobytes(), {}
    return np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(s.tolist(), e.tolist())), np.int64, len(s))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = 1 << 21, second: bool = False) -> np.ndarray:
    """64-bit hash of each byte range (ends ascending), worked off in blocks so that memory stays flat for any text length; second: another one."""
    out = np.empty(len(s), U64)
    base, table = (_P2, _BYTE2) if second else (_P, _BYTE)
    inv = inverse(base)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + block, "right")))
        a, b = int(s[i]), int(e[j - 1])
        if b - a > 2 * block:  # one enormous word: fold it block by block
            h, scale = 0, 1
            for x in range(a, b, block):
                part = data[x : min(b, x + block)]
                h = (h + scale * int((table[part] * powers(base, len(part))).sum(dtype=U64))) % 2**64
                scale = scale * pow(base, len(part), 2**64) % 2**64
            out[i] = h
        else:
            c = np.zeros(b - a + 1, U64)
            np.cumsum(table[data[a:b]] * powers(base, b - a), out=c[1:])
            out[i:j] = (c[e[i:j] - a] - c[s[i:j] - a]) * powers(inv, b - a + 1)[s[i:j] - a]
        i = j
    return mix(out + (e - s).astype(U64))


def kgrams(h: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hash of h[i:i+k] for each i; document borders are the caller's business."""
    if len(h) < k:
        return np.zeros(0, U64)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(base, len(h)), out=c[1:])
    return mix((c[k:] - c[:-k]) * powers(inverse(base), len(h))[: len(h) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, in log2(w) passes."""
    if len(x) < w:
        return x[:0]
    m, size = x, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size :][: len(x) - w + 1]) if size < w else m


def inside(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """For n words in documents that start at `first`: True where a window of `width` words that
    starts at the word ends in the same document."""
    room = np.zeros(max(0, n - width + 1), bool)
    if len(room):
        last = np.repeat(first[1:], np.diff(first))
        room[:] = last[: len(room)] >= np.arange(len(room)) + width
    return room


def lower(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(arr)


def texts(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """An Arrow array of texts from their joined bytes and byte lengths."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops the byte ranges [s, e) of the joined texts; they may overlap but cross no document.
    Gives (bytes, offsets)."""
    d = np.zeros(len(data) + 1, np.int32)
    np.add.at(d, s, 1)
    np.subtract.at(d, e, 1)
    keep = np.cumsum(d[:-1]) == 0
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return data[keep], kept[off]
