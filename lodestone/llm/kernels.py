"""Vectorised kernels over UTF-8 bytes: spans, 64-bit hashes, pre-tokenisation.

Texts reach a Python worker as Arrow string columns; these kernels work on their value
buffers directly, a few megabytes at a time, so no per-word Python object is made.
Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_POS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix64(np.arange(_POS * 256, dtype=np.uint64))


def mask_of(excluded: bytes | range | list[int]) -> np.ndarray:
    """A byte table that is True but for the given byte values."""
    m = np.ones(256, dtype=bool)
    m[list(excluded)] = False
    return m


SPACES = mask_of([0x20, *range(0x09, 0x0E)])


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes.

    `offsets` has one entry more than there are rows and starts at 0. A row longer than
    the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        base = offsets[lo]
        yield lo, hi, values[base : offsets[hi]], offsets[lo : hi + 1] - base
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which the table is True, inside rows,
    and for each row the index of its first word (with one more entry at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = table[data]
    before = np.empty(n + 1, dtype=bool)
    before[0] = before[n] = False
    before[1:n] = m[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(m & ~before[:n])
    after = np.empty(n, dtype=bool)
    after[:-1] = m[1:]
    after[-1] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a sum over its bytes of a random word for (place, byte),
    mixed with the length. Spans are not empty."""
    lens = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    cum = np.concatenate(([0], np.cumsum(lens)))
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(cum, cum[lo] + CHUNK, side="right")) - 1
        hi = min(len(starts), max(hi, lo + 1))
        ln, at = lens[lo:hi], cum[lo:hi] - cum[lo]
        place = np.arange(cum[hi] - cum[lo], dtype=np.int64)
        b = data[place + np.repeat(starts[lo:hi] - at, ln)]
        place -= np.repeat(at, ln)
        key = (place << 8) | b
        if int(ln.max()) <= _POS:
            v = _TABLE[key]
        else:
            v = mix64(key.astype(np.uint64))
        out[lo:hi] = np.add.reduceat(v, at)
        lo = hi
    return mix64(out ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0].. of lens[0] items, then those of the next, and so on."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For every code point: white space, letter, number or other."""
    import regex

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    cls = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int32)
        c1 = data[lead + 1].astype(np.int32) & 63
        cp = ((b0 & 31) << 6) | c1
        three = np.flatnonzero(b0 >= 0xE0)
        if len(three):
            l3 = lead[three]
            c2 = data[l3 + 2].astype(np.int32) & 63
            cp[three] = ((b0[three] & 15) << 12) | (c1[three] << 6) | c2
            four = np.flatnonzero(b0[three] >= 0xF0)
            if len(four):
                at = three[four]
                c3 = data[lead[at] + 3].astype(np.int32) & 63
                cp[at] = ((b0[at] & 7) << 18) | (c1[at] << 12) | (c2[four] << 6) | c3
        kind = table[cp]
        cls[lead] = kind
        cls[lead + 1] = kind
        if len(three):
            cls[lead[three] + 2] = kind[three]
            if len(four):
                cls[lead[at] + 3] = kind[at]
    return cls


def pretokens(data: np.ndarray, offsets: np.ndarray, glued: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of pre-tokens, and for each row the index of its first one.

    glued=True: contractions, words, numbers and other signs with one blank before them, and
    white space, which together cover the text. glued=False: the same without white space,
    and each digit by itself. Both as the published patterns match from left to right.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cls = byte_classes(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = cls[1:] != cls[:-1]
    doc = np.zeros(n + 1, dtype=bool)
    doc[offsets] = True
    cut |= doc
    cut[n] = True
    at = np.flatnonzero(cut)
    begin, end = at[:-1], at[1:]
    kind = cls[begin]
    inside = ~doc[end]  # the next run is of the same row
    attached = np.zeros(len(begin), dtype=bool)
    if glued:
        ws = np.flatnonzero((kind == SPACE) & inside)
        last = end[ws] - 1
        while True:  # back to the lead byte
            more = (data[last] & 0xC0) == 0x80
            if not more.any():
                break
            last = last - more
        cut[last] = True
        blank = data[last] == 32
        cut[end[ws[blank]]] = False
        attached[ws[blank] + 1] = True
    else:
        digits = np.flatnonzero((cls == NUMBER) & ((data & 0xC0) != 0x80))
        cut[digits] = True
    quote = np.flatnonzero((end - begin == 1) & (data[begin] == 39) & inside & ~attached)
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        e = end[quote]
        room = end[quote + 1] - e
        c0 = data[e]
        c1 = np.where(room > 1, data[np.minimum(e + 1, n - 1)], 0)
        one = np.isin(c0, [115, 116, 109, 100])
        two = ((c0 == 114) & (c1 == 101)) | ((c0 == 118) & (c1 == 101)) | ((c0 == 108) & (c1 == 108))
        for sel, k in ((one, 1), (two, 2)):
            cut[e[sel]] = False
            cut[e[sel] + k] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    if not glued:
        keep = cls[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)
