"""Source divergence audit by count-level bitmaps.

Every source of a language is compared with every other one, and with the
language as a whole, over the terms that enough documents of the language hold.
A term's smoothed share in a group is ``p = 1 + floor(scale * (count + add) /
(N + add * V))``; two groups differ by the sum of ``|p - q|`` over all V terms.

The share depends on the count alone, so terms with one count in a group are one
bitmap: term ids are dense per language (frequent terms first), and a group has,
for every block of 64 ids and every count that occurs there, one 64-bit set. For
two groups, AND and popcount of two sets give the number of terms with this pair
of counts (a joint cell), which is multiplied by ``|p - q|``; the set of count
zero is the complement of all others within the block. Terms are never joined
with terms: a pair of groups costs its levels, not its vocabulary.

1. Words are counted per Arrow slice in numpy, then merged by (language, source,
   term) in Spark; a term's sources are at most one row each after that, so a
   frequent term is no hot key.
2. Terms are ranked (exact distributed ranks), sets are built by ``bit_or``.
3. Blocks are dealt round-robin to slabs of 16, so that frequent terms, which
   have many levels, are spread; sources are dealt to buckets of about 32, and
   each (language, slab, pair of buckets) is one bounded numpy task.

The result is all ordered pairs of sources of a language, by definition
quadratic in the sources of a language; its cost a pair is levels, in blocks.

All arithmetic is exact: shares by decimals in Spark, cells and sums in 64-bit
integers (a sum is at most about twice ``scale`` plus two V).

Defined results: null text, language or source is ''; a group without terms, or
of null texts only, is compared like any other (all its counts are zero); a
language that keeps no term gives value 0 to its pairs; repeated rows are
documents each; ties are broken by the item's UTF-8 bytes; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.llm import words as W
from answerlab.llm.common import own_names, stored
from answerlab.operators.ranking import rank_within
from answerlab.session import ship_package

#: Bytes that end a term: ASCII that is no letter. Fixed by the contract.
_GAPS = (*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))

_SLICE = 16 << 20      # bytes of text counted at a time
_SLAB = 16             # blocks of 64 term ids in one task
_BUCKET = 32           # sources of one side of a task, on average
_ROWS = 256            # sets of one side that meet the other side at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of texts."""
    for batch in batches:
        data, at = W.text_bytes(batch.column("text"))
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(g, len(names)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
            part, own = _LOWER[data[at[i]:at[j]]], at[i:j + 1] - at[i]
            starts, ends, first = W.spans(part, own, _GAPS)
            doc = np.repeat(np.arange(i, j), np.diff(first))
            i = j
            if not len(starts):
                continue
            gap = np.zeros(256, dtype=bool)
            gap[list(_GAPS)] = True
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(part[~gap[part]])).dictionary_encode()
            size = len(column.dictionary)
            held, n = np.unique(doc * size + column.indices.to_numpy(), return_counts=True)  # (document, term)
            cell, back = np.unique(group[held // size] * size + held % size, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(cell // size)), sources.take(pa.array(cell // size)),
                 column.dictionary.take(pa.array(cell % size)).cast(pa.string()),
                 pa.array(np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64)),
                 pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n`` (occurrences in the group and in the
    language) of the terms that at least ``min_docs`` documents of the language
    hold; ``docs`` has non-null strings ``lang, source, text``. Rows lie by
    (lang, term) after one shuffle: the sum by source and the language's sums
    need no other."""
    by_term = Window.partitionBy("lang", "term")
    return (docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("_docs", F.sum("docs").over(by_term)).withColumn("lang_n", F.sum("n").over(by_term))
            .where(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))


def _share(count: str, total: str, add: int, scale: int) -> str:
    """SQL text of the smoothed share; 0 where the language keeps no term."""
    return f"if(v > 0, 1 + (cast({count} + {add} as decimal(20, 0)) * {scale}L) div ({total} + {add}L * v), 0L)"


def _divergence(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of |p - q| over the term ids of one slab, for the pairs of sources
    of two buckets. ``table``: sets (block >= 0), and one row for each source
    (block -1; p is its share at count zero)."""
    lang, slab, low, high = (k.as_py() for k in key)
    block, bits, p, bucket, v, slabs = (table.column(c).to_numpy() for c in ("block", "bits", "p", "bucket", "v", "slabs"))
    code = table.column("source").combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    names, source = code.dictionary, code.indices.to_numpy().astype(np.int64)
    count, v, slabs = len(names), int(v[0]), int(slabs[0])
    mark = block < 0
    zero, side = np.zeros(count, np.int64), np.zeros(count, np.int64)
    zero[source[mark]], side[source[mark]] = p[mark], bucket[mark]
    sums = np.zeros((count, count), np.int64)
    order = np.lexsort((source, block))[mark.sum():]
    blocks, begin = np.unique(block[order], return_index=True)
    left = 0  # terms of blocks in which no source of this task has any
    held = dict(zip(blocks.tolist(), np.split(order, begin[1:])))
    for b in range(slab, -(-v // 64), slabs):
        valid = min(64, v - 64 * b)
        rows = held.get(b)
        if rows is None:
            left += valid
            continue
        mask = np.uint64((1 << valid) - 1)
        sets, src, share = bits[rows].astype(np.int64).view(np.uint64), source[rows], p[rows]
        union = np.zeros(count, np.uint64)
        np.bitwise_or.at(union, src, sets)
        sets, src, share = np.concatenate([sets, mask & ~union]), np.concatenate([src, np.arange(count)]), np.concatenate([share, zero])
        order_ = np.argsort(src, kind="stable")
        sets, src, share = sets[order_], src[order_], share[order_]
        edge = np.searchsorted(src, np.arange(count))
        for i in range(0, len(sets), _ROWS):
            cells = np.bitwise_count(sets[i:i + _ROWS, None] & sets[None, :]).astype(np.int64)
            cells *= np.abs(share[i:i + _ROWS, None] - share[None, :])
            np.add.at(sums, src[i:i + _ROWS], np.add.reduceat(cells, edge, axis=1))
    sums += left * np.abs(zero[:, None] - zero[None, :])
    one, two = np.nonzero((side[:, None] == low) & (side[None, :] == high) & ~np.eye(count, dtype=bool))
    if low != high:  # both orders of a pair come from one task
        one, two = np.concatenate([one, two]), np.concatenate([two, one])
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.take(pa.array(one)), "item": names.take(pa.array(two)),
                     "value": pa.array(sums[one, two])})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, add: int = 5,
          scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other
    source of the language with the sum of differences, most different first;
    part ``term`` the ``top`` terms that the source has more of than its language."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"text": text_col, "lang": lang_col, "source": source_col}).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cells = stored(term_counts(own, min_docs), "term-counts")
    terms = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("_n"))
    ids = (rank_within(terms.withColumn("_least", -F.col("_n")), ["lang"], ["_least", "term"], "id")
           .select("lang", "term", (F.col("id") - 1).alias("id")))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("_n").alias("_lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("_total"))
    found = own.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_docs"))
    of_lang = found.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources"))
    groups = stored(
        found.join(of_lang, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .withColumn("v", F.coalesce("v", F.lit(0))).withColumn("_total", F.coalesce("_total", F.lit(0)))
        .withColumn("slabs", F.greatest(F.lit(1), F.ceil(F.col("v") / (64 * _SLAB))).cast("long"))
        .withColumn("_buckets", F.ceil(F.col("_sources") / _BUCKET).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("source"), F.col("_buckets")).cast("int")), "audited-groups")
    per_group = groups.select("lang", "source", "v", "slabs", "_total", "_lang_total", "_buckets", "bucket")

    sets = (cells.join(ids, ["lang", "term"])
            .withColumn("block", F.shiftright("id", 6)).withColumn("_bit", F.expr("shiftleft(1L, cast(id & 63L as int))"))
            .groupBy("lang", "source", "block", "n").agg(F.bit_or("_bit").alias("bits"))
            .join(per_group, ["lang", "source"])
            .withColumn("slab", F.col("block") % F.col("slabs")).withColumn("p", F.expr(_share("n", "_total", add, scale))))
    marks = (per_group.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
             .withColumn("block", F.lit(-1).cast("long")).withColumn("bits", F.lit(0).cast("long"))
             .withColumn("p", F.expr(_share("0", "_total", add, scale))))
    wanted = ["lang", "slab", "source", "bucket", "block", "bits", "p", "v", "slabs", "_buckets"]
    dealt = (sets.select(*wanted).unionByName(marks.select(*wanted))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
             .withColumn("low", F.least("bucket", "_other")).withColumn("high", F.greatest("bucket", "_other")).drop("_other", "_buckets"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = (dealt.groupBy("lang", "slab", "low", "high").applyInArrow(_divergence, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")))
    more = (cells.join(per_group, ["lang", "source"])
            .withColumn("value", F.expr(f"{_share('n', '_total', add, scale)} - {_share('lang_n', '_lang_total', add, scale)}"))
            .where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(more.select(*columns))
