"""Label lookups as native map expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlab.functions.constants import IGNORE_ID, TAXONOMY

ColumnOrName = Column | str

KEEP = object()  # sentinel: an unknown label maps to itself


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def coarsen(label: ColumnOrName, default=KEEP, taxonomy: Sequence[tuple[str, str]] = TAXONOMY) -> Column:
    """Fine label -> coarse class. ``default`` is used for unknown labels:
    ``KEEP`` keeps the label itself (loader rule), ``None`` gives null, a
    string gives that string (``PARSE_ERROR``, ``UNKNOWN``, ``Ambivalent``)."""
    col = _c(label)
    hit = map_literal(taxonomy)[col]
    if default is KEEP:
        return F.coalesce(hit, col)
    if default is None:
        return hit
    return F.coalesce(hit, F.lit(default))


def label_id(label: ColumnOrName, labels: Sequence[str]) -> Column:
    """P10: label -> dense id of a fixed label list; unknown or missing -> -100."""
    m = F.create_map(*[x for i, lbl in enumerate(labels) for x in (F.lit(lbl), F.lit(i))])
    return F.coalesce(m[_c(label)], F.lit(IGNORE_ID)).cast("int")


def argmax(values: ColumnOrName) -> Column:
    """0-based position of the first maximum of an array."""
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
