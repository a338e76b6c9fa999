"""Hashes of words and word shingles of whole texts, vectorised over blocks of bytes."""

from __future__ import annotations

import functools

import numpy as np

from glyphmill.llm.common import mix

#: Bytes that are hashed at once, about; a longer stretch without white space goes whole.
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n."""
    out = []
    for base in (BASE, INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(byte -> is white space, byte -> byte with A-Z lowered)."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence of uint64 values; they
    depend on the span's content and length only."""
    n = 1 << max(10, int(len(values)).bit_length())
    up, down = powers(n)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True):
    """(word hashes, count of words in each text) of texts in a byte buffer. Words are
    runs without ASCII white space and never cross texts."""
    space, lower = tables()
    values = byte_values()
    hashes, counts, first = [], [], 0
    rows = len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        part = data[a:b]
        inner = offsets[first : last + 1] - a
        inside = ~space[part]
        before = np.empty(len(part), bool)
        if len(part):
            before[0] = False
            before[1:] = inside[:-1]
            heads = inner[:-1][inner[:-1] < len(part)]
            before[heads] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        if len(part):
            after[-1] = False
            after[:-1] = inside[1:]
            tails = inner[1:][inner[1:] > 0] - 1
            after[tails] = False
        end = np.flatnonzero(inside & ~after) + 1
        hashes.append(spans_hash(values[lower[part] if fold else part], start, end))
        counts.append(np.diff(np.searchsorted(start, inner)))
        first = last
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([np.empty(0, np.int64), *counts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Yields for each text the ascending distinct hashes of its shingles of `width` words;
    of all its words, if fewer; nothing without words."""
    hashes, counts = words(data, offsets)
    k = np.uint64(BASE)
    whole = hashes[: max(0, len(hashes) - width + 1)].copy()
    for i in range(1, width):
        whole = whole * k + hashes[i : len(hashes) - width + 1 + i]
    whole = mix(whole)
    at = 0
    for n in counts.tolist():
        if n >= width:
            x = np.sort(whole[at : at + n - width + 1])
            if n > width:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in hashes[at : at + n]:
                    h = h * k + w
            x = mix(np.array([h + np.uint64(n)], np.uint64))
        else:
            x = whole[:0]
        yield x
        at += n
