"""Content-defined anchors: a sample of places that every repeated string shares.

Every window of `length` bytes has one anchor: the place within it whose hash of the
next `gram` bytes is lowest (the leftmost of equal ones). Equal windows have equal
anchors at equal offsets, wherever they are. Consecutive windows mostly share theirs,
so there is one for about (length - gram + 2) / 2 bytes. The *context* of an anchor is
the union of the windows that it is the anchor of.
"""

from __future__ import annotations

import numpy as np

from glyphmill.llm.common import mix
from glyphmill.llm.shingles import byte_values, powers

#: Bytes handled at once; a longer text is handled in overlapping parts.
CHUNK = 1 << 18


def sliding_lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive elements."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def parts(offsets: np.ndarray, length: int):
    """Ranges (start, end) of the buffer that cover all texts' windows, each whole texts
    of about CHUNK bytes or a part of one long text (overlapping by length - 1)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        a, b = int(offsets[row]), int(offsets[last])
        if b - a <= 2 * CHUNK:
            yield a, b
        else:
            for at in range(a, b - length + 1, CHUNK):
                yield at, min(b, at + CHUNK + length - 1)
        row = last


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, end, at, h1, h2) arrays of all anchors of the texts: the text's number, its
    context's first byte and end and the anchor within the text, the hash of the gram and
    a hash of the whole context with the anchor's place in it. Texts shorter than length have none."""
    out = []
    values = byte_values()
    up, down = powers(1 << 20)
    weight = np.uint64(0x9FB21C651E98DF25)
    for a, b in parts(offsets, length):
        n = b - a
        if n < length:
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[a:b]] * up[:n], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        # the place in the low bits makes the leftmost of equal hashes the lowest
        place = np.arange(len(grams), dtype=np.uint64)
        low = sliding_lowest((grams & ~np.uint64((1 << 20) - 1)) | place, length - gram + 1)
        where = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        # windows that end within their text
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, b, side="left"))
        text = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1], a, b)))
        inside = text[: len(low)] == text[length - 1 :]
        start = np.flatnonzero(inside & np.concatenate(([True], (where[1:] != where[:-1]) | ~inside[:-1])))
        stop = np.flatnonzero(inside & np.concatenate(((where[1:] != where[:-1]) | ~inside[1:], [True]))) + length
        at = where[start]
        h2 = (sums[stop] - sums[start]) * down[start]
        h2 = mix(h2 + weight * ((stop - start).astype(np.uint64) * np.uint64(4096) + (at - start).astype(np.uint64)))
        row = text[start]
        base = a - offsets[row]
        out.append((row, start + base, stop + base, at + base, grams[at], h2))
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(none, *out))
