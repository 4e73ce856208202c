"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids (its documents in the order in which the
tokenised table was written, each closed by an end id). In each round, a window
of the output, one sequence long, takes from every source its quantum, target
share x window; what a source could not be given as whole tokens is its deficit
and is carried to the next window. Targets are given shares, or the sources'
shares of the corpus, with which all queues run dry together and every window has
the mixture. Queues with given targets that run dry leave the round; the others
share on.

The quanta are dealt down a tree over the sources (the two lightest parts are
joined first, as in a Huffman code): a part that has been given x tokens gives
the rounded share of x to its left half and the rest to its right half. Neither
ever falls as x grows, so quanta are never negative, and a half is off by half a
token plus its share of what the part is off. A part of two parts or more holds
at most two thirds of the part above, so every source stays within two tokens of
its target at every window's border, with any number of sources and any shares.

The deficit after w windows is thus a closed formula of w, as deep as the tree
(some log2 of the number of sources; a heavy source lies near the root). Any task
can fill its part of any window without hearing from the windows before: deficits
are carried across partitions, and nothing runs in sequence.

1. Tokenise; write ids to the shared folder, with the tokens before each document
   in its own (partition, source).
2. Add up (partition, source) sums, a small table, to the place of each partition
   in each queue.
3. Read the ids back, with the partition's place, and cut them into pieces.

To the driver go one total for each source. The output is cut every ``width``
tokens; the last, shorter sequence is split into powers of two, so nothing is
padded at all.

Defined results: null or empty text is the end id alone; null source is a queue
of its own; repeated rows are packed each; an empty table gives no pieces; extra
columns are ignored, whatever their names. A hot source is only a longer queue.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.llm.common import own_names, stored
from answerlab.llm.tokens import WordEncoder
from answerlab.session import ship_package


def _tokenise(path: str, end_id: int, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = WordEncoder(path, plain_specials), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode(batch.column("text"))]
            starts = []
            for source, x in zip(batch.column("source").to_pylist(), ids):
                starts.append(before.get(source, 0))
                before[source] = starts[-1] + len(x)
            wide = "<u2" if len(encoder.ends) <= 1 << 16 else "<u4"
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(wide).tobytes() for x in ids], pa.binary())],
                ["doc_id", "source", "part", "local", "n", "ids"])
    return run


def _halves(weights: list[int]) -> list[list[tuple[int, int, bool]]]:
    """The way to each source down the tree over the positive weights, from the
    root: (weight of the left half, weight of the whole, whether it goes left)."""
    heap = [(w, s) for s, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int, int, bool]] = {}  # part: (part above, left, whole, is left)
    part = len(weights)
    while len(heap) > 1:
        (right, r), (left, l) = heapq.heappop(heap), heapq.heappop(heap)
        above[l], above[r] = (part, left, left + right, True), (part, left, left + right, False)
        heapq.heappush(heap, (left + right, part))
        part += 1
    ways = []
    for s in range(len(weights)):
        way, at = [], s
        while at in above:
            at, *step = above[at]
            way.append(tuple(step))
        ways.append(way[::-1])
    return ways


class Mixture:
    """Which tokens of which queue stand where. ``totals``: tokens per source;
    ``targets``: share per source (sources without one come after all others)."""

    def __init__(self, totals: list[int], targets: list[float] | None, width: int):
        self.width, self.total = width, sum(totals)
        self.full = self.total // width
        # Phases: between two phases a queue runs dry. ends[k][s]: tokens of s used up before phase k.
        weights = [Fraction(t) for t in (totals if targets is None else targets)]
        used, self.ends = [0] * len(totals), [[0] * len(totals)]
        while used != list(totals):
            open_ = [s for s in range(len(totals)) if used[s] < totals[s]]
            rate = {s: weights[s] for s in open_ if weights[s] > 0} or {s: Fraction(totals[s]) for s in open_}
            time = min((totals[s] - used[s]) / w for s, w in rate.items())
            used = [totals[s] if s in rate and (totals[s] - used[s]) / rate[s] == time
                    else min(totals[s], used[s] + round(rate.get(s, 0) * time)) for s in range(len(totals))]
            self.ends.append(used)
        big = self.total >= 1 << 31  # products of two counts then leave 64 bits
        self.kind = object if big else np.int64
        self.ways = [_halves([y - x for x, y in zip(a, b)]) for a, b in zip(self.ends, self.ends[1:])]
        self.ends = np.array(self.ends, dtype=self.kind)
        begin = self.ends.sum(axis=1)
        self.begin, self.gain = begin[:-1], np.diff(self.ends, axis=0)
        self.length = np.diff(begin)
        self.count = [-(-int(n) // width) for n in self.length]
        tail, at = self.total % width, self.full * width
        self.cuts = [at]  # sequence borders behind the full ones
        for bit in reversed(range(width.bit_length())):
            if tail >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))

    def _given(self, k: int, i: np.ndarray) -> np.ndarray:
        """Tokens that phase k has given out before its window i."""
        return np.minimum(i.astype(self.kind) * self.width, self.length[k])

    def border(self, k: int, i: np.ndarray) -> np.ndarray:
        """Place in the output where window i of phase k begins."""
        return self.begin[k] + self._given(k, i)

    def used(self, k: int, s: int, i: np.ndarray) -> np.ndarray:
        """Tokens of source s that stand before window i of phase k."""
        x = self._given(k, i)
        for left, whole, is_left in self.ways[k][s]:
            half = (x * left + whole // 2) // whole
            x = half if is_left else x - half
        return self.ends[k][s] + x

    def before(self, k: int, s: int, i: np.ndarray) -> np.ndarray:
        """Place in the output of the first token of s in window i of phase k:
        in a window, the left half of a part stands before the right half."""
        x, y = self._given(k, i), self._given(k, i + 1)
        at = self.begin[k] + x
        for left, whole, is_left in self.ways[k][s]:
            a, b = (x * left + whole // 2) // whole, (y * left + whole // 2) // whole
            if is_left:
                x, y = a, b
            else:
                at, x, y = at + b - a, x - a, y - b
        return at

    def window(self, k: int, s: int, x: np.ndarray) -> np.ndarray:
        """Window of phase k in which token x of source s stands."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.count[k], np.int64)
        while (high - low > 1).any():
            mid = (low + high) // 2
            right = (self.used(k, s, mid) <= x) & (high - low > 1)
            low, high = np.where(right, mid, low), np.where(~right & (high - low > 1), mid, high)
        return low

    def segments(self, s: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut documents (queue places ``start``, lengths ``n``) of source s:
        (document, queue place, place in the output, length) of each piece
        within one window."""
        parts = []
        for k in range(len(self.gain)):
            if not self.gain[k][s]:
                continue
            lo, hi = np.maximum(start, self.ends[k][s]), np.minimum(start + n, self.ends[k + 1][s])
            doc = np.flatnonzero(lo < hi)
            if not len(doc):
                continue
            lo, hi = lo[doc], hi[doc]
            a, b = self.window(k, s, lo), self.window(k, s, hi - 1)
            each = b - a + 1
            i = np.repeat(a - (np.cumsum(each) - each), each) + np.arange(each.sum())
            doc, lo, hi = np.repeat(doc, each), np.repeat(lo, each), np.repeat(hi, each)
            seen, back = np.unique(i, return_inverse=True)
            begin, end, place = self.used(k, s, seen)[back], self.used(k, s, seen + 1)[back], self.before(k, s, seen)[back]
            x, y = np.maximum(lo, begin), np.minimum(hi, end)
            some = x < y
            parts.append([v[some].astype(np.int64) for v in (doc, x, place + x - begin, y - x)])
        return tuple(np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [()] * 4))

    def sequences(self, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut segments at sequence borders: (segment, tokens before within it,
        length, sequence, offset in it)."""
        cuts = np.array(self.cuts, np.int64)

        def number(at):
            return np.where(at < cuts[0], at // self.width, self.full + np.searchsorted(cuts, at, side="right") - 1)

        def begins(seq):
            return np.where(seq < self.full, seq * self.width, cuts[np.clip(seq - self.full, 0, len(cuts) - 1)])

        a, b = number(place), number(place + n - 1)
        each = b - a + 1
        seq = np.repeat(a - (np.cumsum(each) - each), each) + np.arange(each.sum())
        part = np.repeat(np.arange(len(place)), each)
        x = np.maximum(place[part], begins(seq))
        y = np.minimum((place + n)[part], begins(seq + 1))
        return part, x - place[part], y - x, seq, x - begins(seq)


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1, targets: dict[str | None, float] | None = None,
         plain_specials: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, ids`` (little-endian
    uint32), ``doc_tokens, sequence_id, offset``. ``plain_specials``: strings of
    special tokens in texts are plain text, and cannot pass for an end id."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "source": source_col, "text": text_col})
    kinds = [own.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    rows = stored(own.mapInArrow(_tokenise(tokenizer_path, end_id, plain_specials),
                                 f"doc_id {kinds[0]}, source {kinds[1]}, part long, local long, n long, ids binary"), "tokens")
    sums = rows.groupBy("part", "source").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long"))
                    .select(F.col("part").alias("_part"), F.col("source").alias("_source"), "_base", "_n"), "places")
    totals = {r[0]: int(r[1]) for r in places.groupBy("_source").agg(F.sum("_n")).orderBy("_source").collect()}
    names = list(totals)
    number = {x: s for s, x in enumerate(names)}
    mixture = Mixture([totals[x] for x in names], None if targets is None else [targets.get(x, 0.0) for x in names], width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of: dict = {}
            for i, x in enumerate(batch.column("source").to_pylist()):
                rows_of.setdefault(x, []).append(i)
            starts, n = (batch.column(c).to_numpy() for c in ("start", "n"))
            raw = batch.column("ids").to_pylist()
            out = []
            for name, own in rows_of.items():
                own = np.array(own, np.int64)
                doc, x, place, size = mixture.segments(number[name], starts[own], n[own])
                part, skip, length, seq, offset = mixture.sequences(place, size)
                row = own[doc[part]]
                out.append([row, x[part] + skip - starts[row], length, seq, offset])
            row, start, length, seq, offset = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 5
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").tobytes() for x, k in zip(raw, n)]
            pieces = [ids[r][4 * a:4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("source").take(at), pa.array(start), pa.array(length),
                 pa.array(pieces, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(offset)],
                ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = rows.join(places.drop("_n"), (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return (placed.select("doc_id", "source", (F.col("_base") + F.col("local")).alias("start"), "n", "ids")
            .mapInArrow(cut, f"doc_id {kinds[0]}, source {kinds[1]}, start long, length long, ids binary, doc_tokens long, "
                        "sequence_id long, offset long"))


def digest(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of :func:`pack` with a checksum in place of the ids; ids are
    those of the tokenizer as it is loaded."""
    p = pack(docs, tokenizer_path, width, end_id, plain_specials=False)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
