"""Line deduplication by overlapping three-line windows: the hashes of
consecutive lines are hashed together, repeated windows are found over the whole
corpus (see :mod:`answerlab.llm.repeats`), and every occurrence but the first is
removed. The first is the one with the least (id, row, line); removed windows
merge into covered lines, which go with their line break.

Lines are the non-empty pieces between ``\\n``; empty lines are no part of a
window and stay. Where a window repeats itself in overlapping places (four equal
lines), lines under the later one go although the first covers them too.

Defined results: null and empty text and texts of fewer than three lines stay as
they are; null ids come first in the order; repeated rows are copies like any
others; an empty table gives no rows; extra columns stay as they are, whatever
their names. Ids are of any type that Arrow orders (integers, strings, decimals,
dates, times, binary).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.llm import words as W
from answerlab.llm.repeats import chunked, covered, doc_rank, later, resolve


def _windows(table: pa.Table, text: str, width: int):
    data, at = W.text_bytes(table[text])
    starts, ends, first = W.spans(data, at, W.LINE_GAPS)
    pos, values = W.window_hashes(W.span_hashes(data, starts, ends), first, width)
    return data, at, starts, ends, first, pos, values


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, **sizes: int) -> DataFrame:
    """The columns of ``docs``, with the later occurrences taken out of
    ``text_col``, followed by ``n_lines`` and ``n_removed_lines``."""
    rows, bits = chunked(docs, text_col, **sizes)
    text, ident = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
    names = [f"c{i}" for i in range(len(docs.columns))]

    def hashes(table: pa.Table):
        _, _, _, _, first, pos, values = _windows(table, text, width)
        return values, np.searchsorted(first, pos, side="right") - 1

    def finish(table: pa.Table, answers: np.ndarray) -> pa.Table:
        data, at, starts, ends, first, pos, values = _windows(table, text, width)
        doc = np.searchsorted(first, pos, side="right") - 1
        gone = covered(len(starts), pos[later(values, doc_rank(table, ident)[doc], answers)], width)
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = np.diff(total[first])
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts[gone]] += 1
        keep[ends[gone]] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8) == 0
        last = np.zeros(len(data) + 1, dtype=bool)
        last[at] = True
        e = ends[gone]
        keep[e[~last[e]]] = False  # the line break behind a removed line
        changed = [data[a:b][keep[a:b]].tobytes().decode() if n else None for a, b, n in zip(at[:-1], at[1:], removed)]
        old = table[text].cast(pa.string())
        new = pc.if_else(pa.array(removed > 0), pa.array(changed, pa.string()), old)
        return pa.table({n: new if n == text else table[n] for n in names} | {
            "n_lines": pa.array(np.diff(first), pa.int64()), "n_removed_lines": pa.array(removed, pa.int64())})

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + [
        T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType())])
    return resolve(rows, bits, hashes, finish, schema, ident).toDF(*docs.columns, "n_lines", "n_removed_lines")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_removed_lines, kept_sha256`` of every document."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = dedup_lines(own, "doc_id", "text")
    return done.select(F.col("doc_id").alias(id_col), "n_lines", "n_removed_lines",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
