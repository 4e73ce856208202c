"""The similarity ratio of two texts by matching blocks, for texts of any length.

``sequence_ratio`` is the ratio of Python's ``difflib.SequenceMatcher(None, a,
b)``: 2 M / T, where M adds up the blocks found by taking the longest common
block (the first one in ``a``, then in ``b``), and again on both sides of it. In a
text ``b`` of 200 characters or more, characters that make up over 1 % of it
("popular") cannot begin or carry a block, only extend one.

difflib compares characters pair by pair. Here a longest block is found by
bisecting its length: 64-bit rolling hashes of all windows of a length, in both
texts, by numpy; a match is then compared character by character. That is n log n
for each level of blocks. Short pieces are compared directly.

With a ``limit`` the work ends as soon as it is decided on which side of it the
ratio lies: matched blocks bound it from below, and the lengths of the open
pieces from above; the bound is returned then.
"""

from __future__ import annotations

import numpy as np

#: Pieces up to so many pairs of characters are compared directly.
_DIRECT = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Text:
    """Characters as numbers, with prefix hashes and the powers they need."""

    def __init__(self, text: str, powers: np.ndarray):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = (self.points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * powers[:len(mixed)], dtype=np.uint64)))

    def windows(self, lo: int, hi: int, size: int, inverse: np.ndarray) -> np.ndarray:
        """Hashes of all windows of ``size`` characters in [lo, hi)."""
        return (self.sums[lo + size:hi + 1] - self.sums[lo:hi - size + 1]) * inverse[lo:hi - size + 1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


class _Matcher:
    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        up, self.inverse = _powers(max(len(a), len(b)) + 1)
        self.ta, self.tb = _Text(a, up), _Text(b, up)
        kinds, of, count = np.unique(self.tb.points, return_inverse=True, return_counts=True)
        popular = (count > len(b) // 100 + 1) if len(b) >= 200 else np.zeros(len(kinds), bool)
        self.popular = set(map(chr, kinds[popular].tolist()))
        self.marks = np.concatenate(([0], np.cumsum(popular[of]))) if len(b) else np.zeros(1, np.int64)

    def _direct(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, (i, j) = 0, (alo, blo)
        at: dict[str, list[int]] = {}
        for y in range(blo, bhi):
            if self.b[y] not in self.popular:
                at.setdefault(self.b[y], []).append(y)
        before: dict[int, int] = {}
        for x in range(alo, ahi):
            now = {}
            for y in at.get(self.a[x], ()):
                k = now[y] = before.get(y - 1, 0) + 1
                if k > best:
                    best, i, j = k, x - k + 1, y - k + 1
            before = now
        return i, j, best

    def _common(self, alo: int, ahi: int, blo: int, bhi: int, size: int) -> tuple[int, int] | None:
        """First window of ``size`` in a (then in b) that both hold, without popular characters."""
        one, two = self.ta.windows(alo, ahi, size, self.inverse), self.tb.windows(blo, bhi, size, self.inverse)
        plain = np.flatnonzero(self.marks[blo + size:bhi + 1] == self.marks[blo:bhi - size + 1])
        if not len(plain):
            return None
        order = np.argsort(two[plain], kind="stable")
        found = two[plain][order]
        at = np.minimum(np.searchsorted(found, one), len(found) - 1)
        for x in np.flatnonzero(found[at] == one):
            y = int(plain[order[at[x]]])
            if np.array_equal(self.ta.points[alo + x:alo + x + size], self.tb.points[blo + y:blo + y + size]):
                return alo + int(x), blo + y
        return None

    def _longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        if (ahi - alo) * (bhi - blo) <= _DIRECT:
            i, j, size = self._direct(alo, ahi, blo, bhi)
        else:
            low, high, (i, j) = 0, min(ahi - alo, bhi - blo), (alo, blo)
            step = 4
            while low < high:  # doubling first: most blocks are short
                mid = min(high, step) if step else (low + high + 1) // 2
                hit = self._common(alo, ahi, blo, bhi, mid)
                if hit:
                    low, (i, j) = mid, hit
                    step = 2 * step if step and mid == step else 0
                else:
                    high, step = mid - 1, 0
            size = low
        while i > alo and j > blo and self.a[i - 1] == self.b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and self.a[i + size] == self.b[j + size]:
            size += 1
        return i, j, size

    def ratio(self, limit: float | None) -> float:
        total = len(self.a) + len(self.b)
        if not total:
            return 1.0
        matched, bound = 0, min(len(self.a), len(self.b))
        pieces = [(0, len(self.a), 0, len(self.b))]
        while pieces:
            if limit is not None and 2.0 * matched / total > limit:
                return 2.0 * matched / total
            if limit is not None and 2.0 * (matched + bound) / total <= limit:
                return 2.0 * (matched + bound) / total
            pieces.sort(key=lambda p: min(p[1] - p[0], p[3] - p[2])) if limit is not None and len(pieces) < 64 else None
            alo, ahi, blo, bhi = pieces.pop()
            bound -= min(ahi - alo, bhi - blo)
            i, j, size = self._longest(alo, ahi, blo, bhi)
            if size:
                matched += size
                for piece in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                    if piece[0] < piece[1] and piece[2] < piece[3]:
                        pieces.append(piece)
                        bound += min(piece[1] - piece[0], piece[3] - piece[2])
        return 2.0 * matched / total


def sequence_ratio(a: str, b: str, limit: float | None = None) -> float:
    """The ratio; with ``limit`` perhaps a bound that lies on the same side of it
    (above: over the limit; else at most the limit)."""
    return _Matcher(a, b).ratio(limit)
