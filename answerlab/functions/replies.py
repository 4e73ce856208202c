"""Raw model reply -> label, as native column expressions.

Each rule list is unrolled at plan time into a ``CASE WHEN`` chain over the
given label list, so the work per row is a few string searches inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlab.functions.constants import DIRECT_LABEL_ORDER, PARSE_ERROR, REPLY_SHORTCUTS
from answerlab.functions.text import py_strip

ColumnOrName = Column | str

# --- fixed values: label order used by the JSON / containment rules of the
# question-decomposition step (nine labels) ---
CHAIN_LABEL_ORDER = ["Explicit", "Declining to answer", "Claims ignorance", "Dodging", "Deflection",
                     "General", "Implicit", "Partial/half-answer", "Clarification"]


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains(hay: Column, needle: str | Column) -> Column:
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.instr(hay, n) > 0


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    if not cases:
        return default
    expr = F.when(cases[0][0], cases[0][1])
    for cond, val in cases[1:]:
        expr = expr.when(cond, val)
    return expr.otherwise(default)


def _match(raw_l: Column, labels: Sequence[str], both_ways: bool) -> Column:
    cases = [(raw_l == F.lit(lbl.lower()), F.lit(lbl)) for lbl in labels]
    cases += [(_contains(raw_l, key), F.lit(val)) for key, val in REPLY_SHORTCUTS if val in labels]
    for lbl in labels:
        cond = _contains(raw_l, lbl.lower())
        if both_ways:
            cond = cond | _contains(F.lit(lbl.lower()), raw_l)
        cases.append((cond, F.lit(lbl)))
    return _chain(cases, F.lit(PARSE_ERROR))


def normalise_label(raw: ColumnOrName, labels: Sequence[str]) -> Column:
    """O1: exact (stripped, lower-case) -> shortcuts whose target is a valid
    label -> label contained in the reply or reply contained in the label, in
    label order -> PARSE_ERROR. An empty reply therefore gives the first label."""
    return _match(F.lower(py_strip(_c(raw))), labels, both_ways=True)


def normalise_strict(raw: ColumnOrName, labels: Sequence[str]) -> Column:
    """O2: as O1 without the reply-in-label direction."""
    return _match(F.lower(py_strip(_c(raw))), labels, both_ways=False)


def normalise_tagged(raw: ColumnOrName, labels: Sequence[str]) -> Column:
    """O3: ``<label>..</label>`` content by O2, then the last line by O2, then
    the first label contained anywhere, else PARSE_ERROR."""
    r = _c(raw)
    tagged = normalise_strict(F.regexp_extract(r, r"(?is)<label>\s*(.*?)\s*</label>", 1), labels)
    last = normalise_strict(F.element_at(F.split(py_strip(r), "\n"), -1), labels)
    r_l = F.lower(r)
    anywhere = _chain([(_contains(r_l, lbl.lower()), F.lit(lbl)) for lbl in labels], F.lit(PARSE_ERROR))
    return (F.when(tagged != PARSE_ERROR, tagged).when(last != PARSE_ERROR, last).otherwise(anywhere))


def reasoning_steps(raw: ColumnOrName) -> Column:
    """Bodies of all ``<stepN>`` tags, stripped, joined with `` | ``."""
    steps = F.regexp_extract_all(_c(raw), F.lit(r"(?s)<step\d>(.*?)</step\d>"), 1)
    return F.array_join(F.transform(steps, lambda s: py_strip(s)), " | ")


def json_object_text(raw: ColumnOrName) -> Column:
    """Outermost ``{...}`` of a text (first ``{`` to last ``}``), '' if none."""
    return F.regexp_extract(_c(raw), r"(?s)\{.*\}", 0)


def category_from_json(raw: ColumnOrName, labels: Sequence[str] = CHAIN_LABEL_ORDER) -> Column:
    """The first key present of ``category``, ``categoria``, ``label`` in the
    outermost JSON object, as Python writes its value (null is ``None``),
    stripped; if no valid object or none of the keys, the first label contained
    in the reply; else null."""
    text = py_strip(_c(raw))
    v = F.try_parse_json(json_object_text(text))
    is_obj = F.when(v.isNotNull(), F.schema_of_variant(v).startswith("OBJECT"))
    found = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("category", "categoria", "label")])
    key_val = (F.when(F.is_variant_null(found), F.lit("None"))
               .when(F.schema_of_variant(found) == "BOOLEAN", F.initcap(F.try_variant_get(found, "$", "string")))
               .otherwise(F.try_variant_get(found, "$", "string")))
    t_l = F.lower(text)
    contained = _chain([(_contains(t_l, lbl.lower()), F.lit(lbl)) for lbl in labels], F.lit(None).cast("string"))
    return F.when(F.coalesce(is_obj, F.lit(False)) & key_val.isNotNull(), py_strip(key_val)).otherwise(contained)


def contained_label(raw: ColumnOrName, labels: Sequence[str] = DIRECT_LABEL_ORDER, default: str = "Dodging") -> Column:
    """O6 (single reply): first label contained in the reply, else ``default``."""
    r_l = F.lower(_c(raw))
    return _chain([(_contains(r_l, lbl.lower()), F.lit(lbl)) for lbl in labels], F.lit(default))


def evaluated_label(raw: ColumnOrName, retry: ColumnOrName | None = None,
                    labels: Sequence[str] = CHAIN_LABEL_ORDER, default: str = "Dodging") -> Column:
    """O6 (with retry): O5 on the first reply if it is a valid label, else O5 on
    the retry reply if valid, else ``default``."""
    first = category_from_json(raw, labels)
    out = F.when(first.isin(list(labels)), first)
    if retry is not None:
        second = category_from_json(retry, labels)
        out = out.when(second.isin(list(labels)), second)
    return out.otherwise(F.lit(default))


def with_reply_label(df, raw: str, labels: Sequence[str], kind: str = "label", out: str = "pred_label"):
    """O1/O2/O3 on a DataFrame. The normalised reply strings are staged as
    columns first, so the CASE chains compare plain columns instead of
    re-running the strip regex in every branch."""
    r = F.col(raw)
    if kind in ("label", "strict"):
        staged = df.withColumn("_rl", F.lower(py_strip(r)))
        res = staged.withColumn(out, _match(F.col("_rl"), labels, both_ways=(kind == "label")))
        return res.drop("_rl")
    if kind != "tagged":
        raise ValueError(f"unknown kind {kind!r}")
    staged = (df.withColumn("_rt", F.lower(py_strip(F.regexp_extract(r, r"(?is)<label>\s*(.*?)\s*</label>", 1))))
              .withColumn("_rlast", F.lower(py_strip(F.element_at(F.split(py_strip(r), "\n"), -1))))
              .withColumn("_rall", F.lower(r)))
    staged = (staged.withColumn("_pt", _match(F.col("_rt"), labels, both_ways=False))
              .withColumn("_pl", _match(F.col("_rlast"), labels, both_ways=False)))
    anywhere = _chain([(_contains(F.col("_rall"), lbl.lower()), F.lit(lbl)) for lbl in labels], F.lit(PARSE_ERROR))
    res = staged.withColumn(out, F.when(F.col("_pt") != PARSE_ERROR, F.col("_pt"))
                            .when(F.col("_pl") != PARSE_ERROR, F.col("_pl")).otherwise(anywhere))
    return res.drop("_rt", "_rlast", "_rall", "_pt", "_pl")
