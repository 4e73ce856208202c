"""Plain-Python versions of the operators' definitions, and awkward tables."""

from __future__ import annotations

import collections
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns named like the operators' own
    T.StructField("_k", T.StringType()), T.StructField("key", T.StringType()), T.StructField("chunk", T.StringType()),
    T.StructField("row_key", T.LongType()), T.StructField("c0", T.StringType()), T.StructField("_row", T.StringType()),
    T.StructField("_text", T.StringType()), T.StructField("n_words", T.LongType())])


def awkward(spark, texts=(), empty=False):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"w{i}x{i % 13}" for i in range(30_000))
    rows = [(1, "Alpha beta gamma delta.\nSecond line here now.\nThird line stays too.\n", "en", "a"),
            (2, None, "en", "a"), (3, "", None, None), (4, "   \t\n ", "de", "b"), (5, long_text, "en", None),
            (5, long_text, "en", None), (None, "no id on this row at all", "en", "a"), (None, None, None, None),
            (6, "Ünïcödé wörds — ñandú 東京 😀 ok", "es", "c"), (7, "x", "fr", "c"), (8, "....... !!! 123 456", None, "c"),
            (9, "<|endoftext|> ### User: </turn> \\ \x00 a b", "en", "a")]
    rows += [(100 + i, t, "en", "s%d" % (i % 3)) for i, t in enumerate(texts)]
    if empty:
        rows = []
    return spark.createDataFrame([(*r, len(r[1] or ""), "e1", "e2", None, 3, "e4", "e5", "e6", 7) for r in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def substring_removed(texts, width):
    """(words, flags) of every text."""
    all_words = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i:i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((w, gone))
    return out


def lines_removed(rows, width=3):
    """(text left, removed) by index; rows: (id, text) in input order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        parts = (text or "").split("\n")
        at = [j for j, x in enumerate(parts) if x]
        gone = set()
        for j in range(len(at) - width + 1):
            window = tuple(parts[k] for k in at[j:j + width])
            if window in seen:
                gone.update(at[j:j + width])
            seen.add(window)
        left = "".join(x + ("\n" if j < len(parts) - 1 else "") for j, x in enumerate(parts) if j not in gone)
        out[i] = (left if gone else text, len(gone))
    return [out[i] for i in range(len(rows))]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def near_components(rows, width, percent=80):
    """Index -> set of indexes in the same component (texts without words: alone)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]
