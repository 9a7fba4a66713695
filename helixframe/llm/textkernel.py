"""Vectorised text kernels over Arrow string buffers: words, their hashes and shingle hashes, in numpy.

Everything works on the UTF-8 bytes of a slice of rows, so that the work per row has no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0], _POWERS[1]


def byte_table(separators: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(separators)] = True
    return found


#: Separators of the words [^\x20\x09-\x0D]+.
BLANKS = byte_table(b" \t\n\x0b\x0c\r")
#: Separators of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one entry more than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside.view(np.int8))
    start, end = step == 1, step == -1
    # a row's edge ends a word that would run into the next row
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    both = edges[inside[edges] & inside[edges + 1]]
    start[both] = True
    end[both] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets, "left")


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the polynomial hash of any span."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each row); A-Z count as a-z."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, separators)
    return span_hash(prefix_hash(data), starts, ends), starts, ends, first


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each position that has k words left (row edges are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _M1 + hashes[j : j + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole word sequence, in an array of one."""
    out = _U(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _M1 + h
    return mix(np.array([out], np.uint64))
