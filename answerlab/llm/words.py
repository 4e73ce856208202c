"""Vectorised words, lines and Rabin-Karp hashes over Arrow string columns.

Used inside tasks on one Arrow batch or one bounded group at a time. A word is
a maximal run of bytes outside a set of gap bytes (all gaps here are ASCII, so
UTF-8 words are cut exactly where the text is).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_GAPS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LINE_GAPS = (0x0A,)

#: Bytes (or words) that one block of prefix sums covers.
_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Each byte value as a 64-bit value, and the same with A-Z as a-z.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
LOWER_BYTES = BYTES.copy()
LOWER_BYTES[65:91] = BYTES[97:123]

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_tables.get("pow", ())) < n:
        size = max(n, _BLOCK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("pow", _BASE), ("inv", inverse)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, gaps: tuple[int, ...] = WORD_GAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each text the
    index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    is_gap = np.zeros(256, dtype=bool)
    is_gap[list(gaps)] = True
    gap = is_gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """64-bit polynomial hash of every span, from prefix sums over blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        stop = ends[j - 1]
        up, down = _powers(int(stop - base) + 1)
        sums = np.zeros(int(stop - base) + 1, dtype=np.uint64)
        np.cumsum(table[data[base:stop]] * up[:stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _BASE
        i = j
    return mix(out)


def window_hashes(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of every window of ``width`` consecutive values that
    lies in one text: a polynomial rolled over the values by prefix sums."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.empty(n - width + 1, dtype=np.uint64)
    up, down = _powers(_BLOCK + width + 1)
    for i in range(0, n - width + 1, _BLOCK):
        j = min(n - width + 1, i + _BLOCK)
        sums = np.zeros(j - i + width, dtype=np.uint64)
        np.cumsum(values[i:j + width - 1] * up[:j - i + width - 1], out=sums[1:])
        hashes[i:j] = (sums[width:width + j - i] - sums[:j - i]) * down[:j - i]
    inside = np.ones(n + 1, dtype=bool)
    for back in range(1, width):  # the last width - 1 words of a text begin no window
        cut = first[1:] - back
        inside[cut[cut >= first[:-1]]] = False
    at = np.flatnonzero(inside[:n - width + 1])
    return at, mix(hashes[at])


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct 64-bit values: the upper 48 bits as differences of the
    least sufficient width, the lower 16 bits as they are."""
    upper, lower = values >> np.uint64(16), values.astype(np.uint16)
    steps = np.diff(upper, prepend=np.uint64(0))
    head = upper[:1].astype(np.uint64).tobytes()
    steps[:1] = 0
    wide = 4 if not len(steps) or int(steps.max()) < 1 << 32 else 8
    return bytes([wide]) + head + lower.tobytes() + steps.astype(f"<u{wide}").tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    wide = packed[0]
    n = (len(packed) - 9) // (wide + 2) if len(packed) > 9 else 0
    if not n:
        return np.zeros(0, np.uint64)
    head = np.frombuffer(packed, np.uint64, 1, 1)[0]
    lower = np.frombuffer(packed, np.uint16, n, 9)
    steps = np.frombuffer(packed, f"<u{wide}", n, 9 + 2 * n).astype(np.uint64)
    return ((np.cumsum(steps) + head) << np.uint64(16)) | lower.astype(np.uint64)
