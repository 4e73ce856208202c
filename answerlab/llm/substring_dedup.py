"""Substring deduplication: every window of ``width`` consecutive words of every
document gets a Rabin-Karp hash; hashes are counted in Spark (see
:mod:`answerlab.llm.repeats`); all words under a window that also starts
anywhere else, in the same document or another, go. Repeated windows merge into
maximal removal intervals. Windows are judged on the input.

Defined results: null or empty text has no words and an empty kept text; a text
shorter than the window keeps all its words; repeated rows remove each other's
windows like any copies; an empty table gives no rows; extra columns stay as
they are, whatever their names. Texts are processed whole, of any length that
fits a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.llm import words as W
from answerlab.llm.repeats import chunked, covered, repeated, resolve, runs


def _windows(table: pa.Table, text: str, width: int):
    data, at = W.text_bytes(table[text])
    starts, ends, first = W.spans(data, at)
    pos, values = W.window_hashes(W.span_hashes(data, starts, ends), first, width)
    return data, at, starts, ends, first, pos, values


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = 35, **sizes: int) -> DataFrame:
    """The columns of ``docs`` followed by ``n_words``, ``n_removed``, ``removed``
    (word intervals, end exclusive) and ``kept_text`` (kept words joined by one
    space); the appended columns stand last even where names clash."""
    rows, bits = chunked(docs, text_col, **sizes)
    text = f"c{docs.columns.index(text_col)}"
    names = [f"c{i}" for i in range(len(docs.columns))]

    def hashes(table: pa.Table):
        _, _, _, _, first, pos, values = _windows(table, text, width)
        return values, pos

    def finish(table: pa.Table, answers: np.ndarray) -> pa.Table:
        data, at, starts, ends, first, pos, values = _windows(table, text, width)
        gone = covered(len(starts), pos[repeated(values, answers)], width)
        doc, lo, hi = runs(gone, first)
        # Kept words and one space behind each, all others left out.
        flat, keep = data.copy(), np.zeros(len(data) + 1, np.int8)
        s, e = starts[~gone], ends[~gone]
        keep[s] += 1
        keep[e] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
        # A word that ends a text may be followed at once by the next text: no place for a space, none wanted.
        last = np.zeros(len(data) + 1, dtype=bool)
        last[at] = True
        gap = e[~last[e]]
        flat[gap], keep[gap] = 0x20, True
        kept = [flat[a:b][keep[a:b]].tobytes().rstrip(b" ").decode() for a, b in zip(at[:-1], at[1:])]
        cuts = np.searchsorted(doc, np.arange(len(at)))
        spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
        total = np.concatenate(([0], np.cumsum(gone)))
        return pa.table({n: table[n] for n in names} | {
            "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(np.diff(total[first]), pa.int64()),
            "removed": spans, "kept_text": pa.array(kept, pa.string())})

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span),
        T.StructField("kept_text", T.StringType())])
    return resolve(rows, bits, hashes, finish, schema).toDF(*docs.columns, "n_words", "n_removed", "removed", "kept_text")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every document."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = remove_repeats(own, "text", width)
    return done.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
