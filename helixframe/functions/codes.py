"""Kernels over sequences of A, C, G, T and N in numpy, for Python workers: k-mers as 64-bit codes, their counts, and what is
local to a sequence (next occurrences, sliding counts and minima). A chunk holds whole rows, about CHUNK letters of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters that a kernel takes at a time, about; one longer row is a chunk of its own.
CHUNK = 1 << 18
#: Rows that are hashed in step.
STEP = 1 << 14
_BASES = np.frombuffer(b"AGCT", np.uint8)
_CODE = np.zeros(256, np.uint64)
_CODE[_BASES] = range(4)
_DEALT = np.zeros(256, np.uint8)
for _a, _b in zip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ACGTACGTACGTACGTNCGTACGNAN", strict=True):
    _DEALT[[_a, _a + 32]] = _b


def chunks(column: pa.Array, least: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max(CHUNK, least), "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def derived(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from prose, as functions.sequence.derived has them."""
    out = _DEALT[data]
    kept = np.concatenate([[0], np.cumsum(out > 0)])
    return out[out > 0], kept[offsets]


def places(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and place in the chunk of every run of k letters."""
    size = np.maximum(0, np.diff(offsets) - k + 1)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, pos, offsets[row] + pos


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """Two bits a base (A, G, C, T = 0 to 3), first base highest, of the k letters from each place; N counts as A."""
    if k == 1:
        return _CODE[data]
    half = rolled(data, k // 2)
    m = k // 2
    out = half[: max(0, len(half) - m)] << np.uint64(2 * m) | half[m:]
    if k % 2:
        out = out[: max(0, len(data) - k + 1)] << np.uint64(2) | _CODE[data[k - 1 :]]
    return out


def plain(data: np.ndarray, k: int) -> np.ndarray:
    """Whether the k letters from each place have no N."""
    n = np.concatenate([[0], np.cumsum(data == ord("N"))])
    return n[k:] == n[:-k] if len(data) >= k else np.zeros(0, bool)


def spelled(code: np.ndarray, k: int) -> pa.Array:
    """The k-mers of codes as strings."""
    shift = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    return strings(_BASES[(code.astype(np.uint64)[:, None] >> shift & np.uint64(3)).astype(np.intp)].ravel(), np.arange(len(code) + 1) * k)


def coded(kmers: list[str], k: int) -> np.ndarray:
    """Codes of k-mers without N."""
    return rolled(np.frombuffer("".join(kmers).encode(), np.uint8), k)[::k] if kmers else np.zeros(0, np.uint64)


def member(code: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, code), len(ordered) - 1)] == code if len(ordered) else np.zeros(len(code), bool)


def next_same(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For entries ordered by row and position: steps to the next entry of the row with that code, 0 where there is none.
    row * n + the number of the code is one key."""
    if not len(code):
        return np.zeros(0, np.int64)
    o = np.argsort(code, kind="stable")
    same = (code[o[1:]] == code[o[:-1]]) & (row[o[1:]] == row[o[:-1]])
    out = np.zeros(len(code), np.int64)
    out[o[:-1][same]] = (o[1:] - o[:-1])[same]
    return out


def hash32(text: np.ndarray) -> np.ndarray:
    """The first 32 bits of SHA-1 of each row of at most 55 bytes, all rows of a block in step, in buffers that stay in the cache."""
    out = np.empty(len(text), np.int64)
    first = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
    for at in range(0, len(text), STEP):
        rows = text[at : at + STEP]
        block = np.zeros((len(rows), 64), np.uint8)
        block[:, : rows.shape[1]] = rows
        block[:, rows.shape[1]] = 0x80
        block[:, 62:] = divmod(8 * rows.shape[1], 256)
        words = np.ascontiguousarray(block.view(">u4").astype(np.uint32).T)
        a, b, c, d, e = (np.full(len(rows), x, np.uint32) for x in first)
        f, g = np.empty_like(a), np.empty_like(a)
        for t in range(80):
            word = words[t % 16]
            if t > 15:
                for x in (t - 3, t - 8, t - 14):
                    np.bitwise_xor(word, words[x % 16], out=word)
                np.right_shift(word, np.uint32(31), out=f)
                np.left_shift(word, np.uint32(1), out=word)
                np.bitwise_or(word, f, out=word)
            if t < 20:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                constant = 0x5A827999
            elif 40 <= t < 60:
                np.bitwise_or(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_and(b, c, out=g)
                np.bitwise_or(f, g, out=f)
                constant = 0x8F1BBCDC
            else:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                constant = 0x6ED9EBA1 if t < 40 else 0xCA62C1D6
            np.add(e, f, out=e)
            np.add(e, word, out=e)
            np.add(e, np.uint32(constant), out=e)
            np.left_shift(a, np.uint32(5), out=f)
            np.add(e, f, out=e)
            np.right_shift(a, np.uint32(27), out=f)
            np.add(e, f, out=e)
            np.right_shift(b, np.uint32(2), out=f)
            np.left_shift(b, np.uint32(30), out=b)
            np.bitwise_or(b, f, out=b)
            a, b, c, d, e = e, a, b, c, d
        out[at : at + STEP] = a + np.uint32(first[0])
    return out


def low_product(a: int, x: np.ndarray) -> np.ndarray:
    """a * x modulo 2**32."""
    return ((x.astype(np.uint64) * np.uint64(a)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width entries in a row, by widths that double."""
    if len(x) < width:
        return x[:0]
    w = 1
    while 2 * w <= width:
        x, w = np.minimum(x[:-w], x[w:]), 2 * w
    return np.minimum(x[: len(x) - width + w], x[width - w :]) if w < width else x


def informative(data: np.ndarray, w: int) -> np.ndarray:
    """Of the w letters from each place: at most w div 50 N, at most one base absent, at most one with fewer than 5."""
    absent, rare, n = 0, 0, None
    for b in b"ACGTN":
        total = np.concatenate([[0], np.cumsum(data == b)])
        count = total[w:] - total[:-w] if len(data) >= w else total[:0]
        if b == ord("N"):
            n = count <= w // 50
        else:
            absent, rare = absent + (count < 1), rare + (count < 5)
    return n & (absent <= 1) & (rare <= 1)


def window_minima(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, k: int, w: int, coefficients: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, position, place and minima of each window of w letters with a valid k-mer: without N and not among the frequent."""
    row, pos, at = places(offsets, w)
    if not len(at):
        return row, pos, at, [pos] * len(coefficients)
    code = rolled(data, k)
    valid = plain(data, k) & ~member(code, frequent)
    x, width, least = np.zeros(len(code), np.uint32), w - k + 1, []
    x[valid] = hash32(np.lib.stride_tricks.sliding_window_view(data, k)[valid])
    held = np.concatenate([[0], np.cumsum(valid)])
    keep = held[at + width] > held[at]
    row, pos, at = row[keep], pos[keep], at[keep]
    for a in coefficients:
        # 32 bits wrap by themselves; what isn't valid is never less than what is
        product = x * np.uint32(a)
        product[~valid] = 0xFFFFFFFF
        least.append(sliding_least(product, width)[at].astype(np.int64))
    return row, pos, at, least


def window_runs(data: np.ndarray, offsets: np.ndarray, k: int, w: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and start of the windows that begin every step letters and hold a k-mer without N; of each run of equal k-mers in one
    of them the number of its window and its length, by window."""
    size = np.maximum(0, np.diff(offsets) - k + 1)
    n = -(-size // step)
    row = np.repeat(np.arange(len(n)), n)
    win = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    if not len(row):
        return row, win, row, row
    width, none = w - k + 1, 1 << 20
    off = np.arange(width)
    at = np.minimum((offsets[row] + win)[:, None] + off, len(data) - k)
    valid = (win[:, None] + off < size[row][:, None]) & plain(data, k)[at]
    each = np.sort(np.where(valid, rolled(data, k)[at].astype(np.int64), none + off), 1)
    some = valid.any(1)
    row, win, each = row[some], win[some], each[some]
    new = np.ones(each.shape, bool)
    new[:, 1:] = each[:, 1:] != each[:, :-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, each.size))
    real = each.ravel()[start] < none
    return row, win, start[real] // width, length[real]
