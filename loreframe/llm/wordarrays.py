"""Words and word n-grams of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text; A-Z count as a-z
in its 64-bit hash. All helpers work on bounded stretches of text, so a batch with one huge text
needs no more scratch space than any other.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20  # bytes hashed at a time; scratch arrays take about 40 times as much

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    table[65:91] = table[97:123]
    return table


_BYTES = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubling: the next block is the first one times base**done
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            tables.append(out)
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _stretch_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``; ``first`` marks bytes that open a text."""
    space = _SPACE[data]
    opens = ~space
    opens[1:] &= space[:-1] | first[1:]
    closes = ~space
    closes[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, n+1 word offsets of the texts)."""
    n = len(offsets) - 1
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + STRETCH, len(data))
        while to < len(data):  # a stretch ends between two words
            room = data[to : to + STRETCH]
            cut = np.flatnonzero(_SPACE[room] | first[to : to + len(room)])
            if len(cut):
                to += int(cut[0])
                break
            to = min(to + STRETCH, len(data))
        s, h = _stretch_words(data[at:to], first[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams per text, repeats included, and their n+1 offsets.

    A text with fewer words than ``size`` gives its whole word sequence as one; without words none.
    """
    counts = np.diff(offsets)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), per)
    at = np.arange(out_offsets[-1]) - out_offsets[text] + offsets[text]
    length = np.minimum(counts[text], size)
    out = mix(length.astype(np.uint64) * np.uint64(_BASE))
    for k in range(size):
        inside = k < length
        if inside.all():
            out = mix(out + words[at + k])
        else:
            out[inside] = mix(out[inside] + words[at[inside] + k])
    return out, out_offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per text and their n+1 offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(offsets))).astype(np.int64)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the machine; a worker outlives its task, and its neighbours need it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together (one row at least)."""
    sizes = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    give_back()
