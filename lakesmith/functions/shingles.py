"""Word shingles of texts in whole Arrow columns.

Words are what stands between white space (``GAPS``). All words of a chunk
are hashed together from their bytes, eight at a time, and shingles from the
hashes of their words. Where texts are compared, words are numbered by their
bytes, so equal shingles are equal texts. Texts are taken in chunks of about
``CHUNK`` bytes, at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
GAPS = b" \t\n\r\f"
_SOLID = np.ones(256, bool)
_SOLID[list(GAPS)] = False
_M = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)     # the first bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[off[0]:off[-1]], off - off[0]


def text_chunks(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of chunks of a string column without nulls."""
    buf, off = _letters(col)
    i = 0
    while i < len(col):
        j = min(len(col), max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1))
        yield i, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each
    row (rows + 1 entries). A text of white space has no word."""
    solid = np.zeros(len(b) + 2, bool)
    solid[1:-1] = _SOLID[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of every word: its length and bytes, eight at a time."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[:len(b)] = b
    at = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))       # the eight bytes from every place on
    size = ends - starts
    out = mix((at[starts] & _BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _M[0]))
    live, k = np.flatnonzero(size > 8), 8
    while len(live):
        left = size[live] - k
        out[live] = mix(out[live] * _M[1] ^ (at[starts[live] + k] & _BYTES[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    return out


def _places(first: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of all shingles of all rows, rows
    ascending; a row with less words is one shingle."""
    count = np.diff(first)
    of = np.maximum(count - shingle + 1, 1)
    row = np.repeat(np.arange(len(count)), of)
    return row, np.arange(len(row)) + (first[:-1] - np.cumsum(of) + of)[row], np.minimum(count, shingle)[row]


def _member(x: np.ndarray, at: np.ndarray, size: np.ndarray, k: int, whole: bool) -> np.ndarray:
    """``x`` of the word ``k`` of every shingle; 0 where it has less words."""
    if whole:
        return x[at + k]
    out = np.zeros(len(at), x.dtype)
    out[size > k] = x[at[size > k] + k]
    return out


def hashed_shingles(b: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64 bits) of every shingle, rows ascending, repeats included."""
    starts, ends, first = words(b, off)
    row, at, size = _places(first, shingle)
    h, whole = word_hashes(b, starts, ends), size.min(initial=shingle) == shingle
    out = size.astype(np.uint64)
    for k in range(shingle):
        out = mix(out * _M[2] + _member(h, at, size, k, whole))
    return row, out


def distinct_in_rows(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending. Rows ascend."""
    value = value.copy()
    cuts = np.flatnonzero(np.diff(row)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
        value[i:j].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[keep], value[keep]


def exact_shingles(b: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the distinct shingles of each row: equal numbers are
    equal shingles, by the bytes of their words."""
    starts, ends, first = words(b, off)
    code = np.zeros(0, np.int64)
    if len(starts):
        lists = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lists), pa.py_buffer(b[_SOLID[b]])])
        code = column.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    row, at, size = _places(first, shingle)
    whole, width, bound, value = size.min(initial=shingle) == shingle, int(code.max(initial=0)) + 1, 1, np.zeros(len(row), np.int64)
    for k in range(shingle):
        if bound * width >= 1 << 62:            # numbers of prefixes keep the number in 64 bits
            value, bound = np.unique(value, return_inverse=True)[1], len(row)
        value, bound = value * width + _member(code, at, size, k, whole), bound * width
    return distinct_in_rows(row, value)


def common_shingles(texts_a: pa.Array, texts_b: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(common, of a, of b) of the pairs of texts, in chunks of pairs: exact
    numbers of distinct shingles."""
    a, b = texts_a.cast(pa.large_string()), texts_b.cast(pa.large_string())
    ends = np.cumsum(np.diff(_letters(a)[1]) + np.diff(_letters(b)[1]))
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2 * CHUNK, "right")))
        n = j - i
        letters, off = _letters(pa.concat_arrays([a.slice(i, n), b.slice(i, n)]))
        row, value = exact_shingles(letters, off, shingle)
        sizes, pair = np.bincount(row, minlength=2 * n), row % n
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        twice = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
        yield np.bincount(pair[1:][twice], minlength=n), sizes[:n], sizes[n:]
        i = j
