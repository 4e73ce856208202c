"""Reply normalisation with labels from a table.

The rules are those of ``functions.replies``, which unrolls a short label list
into a ``CASE`` chain: its cost is rows x labels. Here the labels come from a table
(label, rank), and the time for a reply does not depend on their number: one
multi-pattern automaton finds all labels that a reply holds in one walk over it,
and sorted suffixes of all labels find those that hold the reply. Of the labels
found, the one with the smallest rank wins, as in the chain.

The automaton is built once for each task from the label table, which goes to
every task; it may have ``MAX_LABELS`` rows at most (an error beyond).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.functions.constants import PARSE_ERROR, REPLY_SHORTCUTS
from answerlab.functions.text import py_strip

MAX_LABELS = 200_000


class LabelMatcher:
    """``labels`` in rank order; ``shortcuts``: (text, label) tried before containment."""

    def __init__(self, labels: Sequence[str], shortcuts: Sequence[tuple[str, str]] = tuple(REPLY_SHORTCUTS)):
        import ahocorasick

        self.labels = list(labels)
        self.rank: dict[str, int] = {}
        for i, label in enumerate(self.labels):
            self.rank.setdefault(label.lower(), i)
        self.empty = self.rank.get("")  # every reply holds it
        self.automaton = ahocorasick.Automaton()
        for text, i in self.rank.items():
            if text:
                self.automaton.add_word(text, i)
        if len(self.automaton):
            self.automaton.make_automaton()
        known = set(self.labels)
        self.shortcuts = [(text, label) for text, label in shortcuts if label in known]
        suffixes = sorted((text[i:], r) for text, r in self.rank.items() for i in range(len(text)))
        self.suffixes, self.ranks = [s for s, _ in suffixes], np.array([r for _, r in suffixes], dtype=np.int64)
        self.longest = max(map(len, self.rank), default=0)

    def held(self, reply: str) -> int | None:
        """Smallest rank of the labels that the reply holds."""
        found = min((r for _, r in self.automaton.iter(reply)), default=None) if len(self.automaton) and reply else None
        return found if self.empty is None else self.empty if found is None else min(found, self.empty)

    def holding(self, reply: str) -> int | None:
        """Smallest rank of the labels that hold the reply."""
        if not reply:
            return 0 if self.labels else None
        if len(reply) > self.longest:
            return None
        low = bisect_left(self.suffixes, reply)
        high = bisect_left(self.suffixes, reply + chr(0x10FFFF) * (self.longest + 1), lo=low)
        return int(self.ranks[low:high].min()) if low < high else None

    def match(self, reply: str | None, both_ways: bool) -> str:
        """O1 (``both_ways``) or O2 for a stripped lower-case reply."""
        if reply is None:
            return PARSE_ERROR
        if reply in self.rank:
            return self.labels[self.rank[reply]]
        for text, label in self.shortcuts:
            if text in reply:
                return label
        found = [r for r in (self.held(reply), self.holding(reply) if both_ways else None) if r is not None]
        return self.labels[min(found)] if found else PARSE_ERROR

    def contained(self, reply: str | None, default: str | None) -> str | None:
        """First label that the lower-case reply holds (O6, and the last step of O3)."""
        found = None if reply is None else self.held(reply)
        return default if found is None else self.labels[found]


def labels_of(table: DataFrame, label: str = "label", rank: str = "rank") -> list[str]:
    """The labels in rank order; null labels are left out."""
    rows = table.where(F.col(label).isNotNull()).orderBy(rank, label).select(label).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return [r[0] for r in rows]


def with_table_label(df: DataFrame, raw: str, table: DataFrame, kind: str = "label", out: str = "pred_label", default: str = PARSE_ERROR,
                     label: str = "label", rank: str = "rank") -> DataFrame:
    """``kind``: label (O1), strict (O2), tagged (O3) or contained (O6), as
    ``functions.replies`` does with a list. White space and case are handled by the
    same native expressions."""
    labels = labels_of(table, label, rank)

    @F.arrow_udf("string")  # one row's texts at a time become Python's
    def found(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        matcher = LabelMatcher(labels)

        def one(tag, last, whole):
            if kind in ("label", "strict"):
                return matcher.match(whole, kind == "label")
            if kind == "contained":
                return matcher.contained(whole, default)
            for reply in (tag, last):
                got = matcher.match(reply, False)
                if got != PARSE_ERROR:
                    return got
            return matcher.contained(whole, PARSE_ERROR)

        for part in parts:
            yield pa.array((one(*(x.as_py() for x in row)) for row in zip(*part)), pa.string(), size=len(part[0]))

    r = F.col(raw)
    if kind == "tagged":
        tag = F.lower(py_strip(F.regexp_extract(r, r"(?is)<label>\s*(.*?)\s*</label>", 1)))
        last, whole = F.lower(py_strip(F.element_at(F.split(py_strip(r), "\n"), -1))), F.lower(r)
    elif kind in ("label", "strict", "contained"):
        tag = last = F.lit(None).cast("string")
        whole = F.lower(r) if kind == "contained" else F.lower(py_strip(r))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return df.withColumn(out, found(tag, last, whole))
