"""Which windows of a corpus are repeated, counted in Spark without moving texts
to the counts or counts of all windows to the texts.

1. Every row gets a number and goes to one of many chunks of bounded size; this
   shuffle is used twice (once planned, the second use reads the same files).
2. Each chunk hashes all its windows and announces the distinct hashes, packed,
   one row for each bucket of hashes. However often a window occurs in a chunk,
   it is announced once: a window that a third of all texts hold costs one
   entry per chunk.
3. Each bucket counts its hashes over the chunks and answers each chunk with
   those of its hashes that matter: repeated elsewhere, or first elsewhere.
4. Each chunk meets its answers, and works out its own repeats itself.

A chunk addresses at most ``1 << FAN_BITS`` buckets, however many the corpus
needs. Where it needs more, hashes go through several levels: the chunks of a
region (``1 << FAN_BITS`` of them) meet in the region's coarse buckets, which send
each hash on once, to finer buckets of larger regions; answers come back the same
way. So each chunk or bucket sends a bounded number of rows at each level, and
the number of levels is the logarithm of the corpus (one up to 2 GB, two up to
0.5 TB, three up to 128 TB, with the sizes below).

Equality of windows is equality of 64-bit hashes: with N windows, about N^2 /
2^65 pairs of different windows are taken for equal (0.0005 for 130 million).
Row numbers come from the scan, so the input must be one that recomputes alike
(files, or a written table), as with any retried Spark stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.llm.words import pack_sorted, unpack_sorted
from answerlab.session import ship_package

#: Bytes of text for each chunk, and for each bucket of hashes.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20

#: Buckets that one chunk or bucket sends rows to, and chunks or buckets of a region, as a power of two.
FAN_BITS = 8

_NO_ID = np.iinfo(np.int64).min


def chunked(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(rows, bucket bits): columns by position (c0, c1, ..), ``rid``, ``chunk``."""
    ship_package(docs.sparkSession)
    at = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index(text_col)}")
    total = at.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    bits = max(0, math.ceil(math.log2(max(1.0, total / bucket_bytes))))
    rows = at.withColumn("rid", F.monotonically_increasing_id())
    return rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("long")), bits


def _sorted_isin(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in an ascending pool."""
    if not len(pool):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers in the order of the ids (null first)."""
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy()
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.rank(flat, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)


def doc_rank(table: pa.Table, id_name: str) -> np.ndarray:
    """Rank of each row of a chunk by id (null first), then row number."""
    order = np.lexsort((table["rid"].to_numpy(), _ids(table[id_name])))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def repeated(values: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which window hashes of a chunk start anywhere else."""
    s = np.sort(values)
    twice = s[1:][s[1:] == s[:-1]]
    return _sorted_isin(values, np.union1d(twice, answers))


def later(values: np.ndarray, ranks: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which window occurrences of a chunk are not the corpus's first; ``values``
    lie in text order, ``ranks`` give the order of their documents."""
    order = np.lexsort((np.arange(len(values)), ranks, values))
    s = values[order]
    again = np.zeros(len(values), dtype=bool)
    again[order[1:]] = s[1:] == s[:-1]
    return again | _sorted_isin(values, answers)


def _slices(values: pa.Array, edges: np.ndarray) -> pa.Array:
    """A list for each stretch between consecutive edges, which cover all values."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _sent(found: np.ndarray, done: int, step: int, prefix: int, region: int, child: int, firsts: dict[str, pa.Array]) -> pa.Table:
    """Rows for the buckets of the next ``step`` bits behind ``done`` bits, from
    ascending hashes that agree in the first ``done`` bits."""
    part = (found >> np.uint64(64 - done - step)) & np.uint64((1 << step) - 1) if step else np.zeros(len(found), np.uint64)
    edges = np.searchsorted(part, np.arange((1 << step) + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edges))
    edges = np.append(edges[full], len(found)) if len(full) else np.zeros(1, np.int64)
    out = {"region": pa.array([region] * len(full), pa.int64()), "prefix": pa.array((prefix << step) + full, pa.int64()),
           "child": pa.array([child] * len(full), pa.int64()),
           "packed": pa.array([pack_sorted(found[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())}
    return pa.table(out | {k: _slices(v, edges) for k, v in firsts.items()})


def _announce(hashes: Callable, step: int, fan: int, id_name: str | None):
    def run(table: pa.Table) -> pa.Table:
        values, doc_of = hashes(table)
        chunk, firsts = table["chunk"][0].as_py(), {}
        if id_name is None:
            found = np.unique(values)
        else:
            rank = doc_rank(table, id_name)[doc_of]
            order = np.lexsort((rank, values))
            s = values[order]
            lead = np.ones(len(s), dtype=bool)
            lead[1:] = s[1:] != s[:-1]
            found, at = s[lead], pa.array(doc_of[order[lead]])
            firsts = {"ids": table[id_name].combine_chunks().take(at), "rids": table["rid"].combine_chunks().take(at)}
        return _sent(found, 0, step, 0, chunk >> fan, chunk, firsts)
    return run


def _listed(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks().flatten()


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes that were sent to a bucket, whose row each is of, and their
    order: by hash, then the first occurrence first."""
    found = [unpack_sorted(x) for x in table["packed"].to_pylist()]
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    keys = (_listed(table["rids"]).to_numpy(), _ids(_listed(table["ids"]))) if "ids" in table.column_names else ()
    return values, owner, np.lexsort((*keys, values)) if keys else np.argsort(values, kind="stable")


def _relay(done: int, step: int, fan: int):
    """One coarse bucket of a region: each of its hashes once, to the next level."""
    def run(table: pa.Table) -> pa.Table:
        values, _, order = _merged(table)
        s = values[order]
        lead = np.ones(len(s), dtype=bool)
        lead[1:] = s[1:] != s[:-1]
        region, at = table["region"][0].as_py(), pa.array(order[lead])
        firsts = {k: _listed(table[k]).take(at) for k in ("ids", "rids") if k in table.column_names}
        return _sent(s[lead], done, step, table["prefix"][0].as_py(), region >> fan, region, firsts)
    return run


def _answer(table: pa.Table, above: np.ndarray, down: int) -> pa.Table:
    """One bucket: the answers to those that sent to it, from its own counts and
    the ascending answers it got itself."""
    values, owner, order = _merged(table)
    s = values[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    matters = same[:-1] if "ids" in table.column_names else same[:-1] | same[1:]  # all but the first of a hash, or all of a repeated one
    other = order[matters | _sorted_isin(s, above)]  # by owner, ascending
    other = other[np.argsort(owner[other], kind="stable")]
    by_child = np.split(values[other], np.searchsorted(owner[other], np.arange(1, table.num_rows)))
    child, prefix = table["child"].to_pylist(), table["prefix"][0].as_py() if table.num_rows else 0
    full = [i for i, x in enumerate(by_child) if len(x)]
    return pa.table({"region": pa.array([child[i] for i in full], pa.int64()), "prefix": pa.array([prefix >> down] * len(full), pa.int64()),
                     "packed": pa.array([pack_sorted(by_child[i]) for i in full], pa.binary())})


def _united(answer: pa.Table) -> np.ndarray:
    got = [unpack_sorted(x) for x in answer["packed"].to_pylist()]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def announcements(rows: DataFrame, bits: int, hashes: Callable, id_name: str | None = None) -> tuple[list[DataFrame], list[int]]:
    """The rows sent to the buckets of each level, and the bits of each level."""
    levels = max(1, -(-bits // FAN_BITS))
    steps = [bits * (i + 1) // levels - bits * i // levels for i in range(levels)]
    fans = [FAN_BITS] * (levels - 1) + [63]  # the last level is one region
    kinds = "region long, prefix long, child long, packed binary"
    if id_name:
        kinds += f", ids array<{rows.schema[id_name].dataType.simpleString()}>, rids array<bigint>"
    sent = [rows.groupBy("chunk").applyInArrow(_announce(hashes, steps[0], fans[0], id_name), kinds)]
    for i in range(1, levels):
        sent.append(sent[-1].groupBy("region", "prefix").applyInArrow(_relay(sum(steps[:i]), steps[i], fans[i]), kinds))
    return sent, steps


def resolve(rows: DataFrame, bits: int, hashes: Callable, finish: Callable, schema: T.StructType, id_name: str | None = None) -> DataFrame:
    """Announce, count, answer and finish. ``hashes(table) -> (values, document
    of each)``; ``finish(table, answers) -> table`` gets the ascending hashes of
    the chunk that are repeated elsewhere, or, with ``id_name``, those whose
    first occurrence by (id, row number) lies in another chunk."""
    sent, steps = announcements(rows, bits, hashes, id_name)
    kinds = "region long, prefix long, packed binary"

    def top(down: int) -> Callable:
        return lambda table: _answer(table, np.zeros(0, np.uint64), down)

    def middle(down: int) -> Callable:
        return lambda table, answer: _answer(table, _united(answer), down)

    answers = sent[-1].groupBy("region", "prefix").applyInArrow(top(steps[-1]), kinds)
    for level, step in zip(sent[-2::-1], steps[-2::-1]):
        answers = (level.groupBy("region", "prefix").cogroup(answers.groupBy("region", "prefix"))
                   .applyInArrow(middle(step), kinds))

    def meet(table: pa.Table, answer: pa.Table) -> pa.Table:
        return finish(table, _united(answer))

    return rows.groupBy("chunk").cogroup(answers.groupBy("region")).applyInArrow(meet, schema)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions the windows at distinct ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags that end at document borders: (document,
    start, end), counted from the document's first position."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    border = np.zeros(len(flags) + 1, dtype=bool)
    border[first] = True
    inner = np.zeros(len(flags) + 1, dtype=bool)
    inner[1:-1] = border[1:-1] & flags[1:] & flags[:-1]
    starts, ends = np.flatnonzero((edge == 1) | inner), np.flatnonzero((edge == -1) | inner)
    doc = np.searchsorted(first, starts, side="right") - 1
    return doc, starts - first[doc], ends - first[doc]
