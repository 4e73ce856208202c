"""Vote consolidation (V1-V6) and row filters on labels.

Plan shape: votes live in columns of the same row, so majority and tie-break
are per-row array expressions (no shuffle of the example table). The only
aggregate is annotator reliability, whose size is fixed by
annotators x coarse classes; it is broadcast back by coarse class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.functions.constants import ANNOTATORS, COARSE_LABELS, FINE_LABELS, NO_VOTE, TAXONOMY
from answerlab.functions.labels import coarsen, map_literal
from answerlab.functions.text import py_strip
from answerlab.session import literal_table


def _is_vote(v: Column) -> Column:
    return v.isNotNull() & ~py_strip(v).isin(NO_VOTE)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(conds: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in conds) + ")" if conds else "0"


def _any(conds: list[str]) -> str:
    return "(" + " OR ".join(conds) + ")" if conds else "false"


def _greatest(items: list[str]) -> str:
    return items[0] if len(items) == 1 else f"greatest({', '.join(items)})"


class _Votes:
    """Per-row vote logic as SQL text over plain vote columns (pairwise
    comparisons, O(annotators^2) terms). It is parsed once on the JVM side and
    compiled by whole-stage codegen - no per-row lambda evaluation and no
    expression-by-expression construction from Python."""

    def __init__(self, vals: list[str], valid: list[str]):
        n = len(vals)
        self.vals, self.valid = vals, valid
        same = [[f"({valid[i]} AND {valid[j]} AND {vals[i]} = {vals[j]})" for j in range(n)] for i in range(n)]
        self.cnt = [_count(same[i]) for i in range(n)]
        self.first = [f"({valid[i]} AND NOT {_any([same[i][j] for j in range(i)])})" for i in range(n)]
        self.n_valid = _count(valid)


def vote_array(annotators: Sequence[str] = ANNOTATORS) -> Column:
    """All votes of a row as array<struct<annotator_no, annotator, vote>> in
    annotator order (before the validity filter)."""
    return F.array(*[F.struct(F.lit(i + 1).alias("annotator_no"), F.lit(a).alias("annotator"),
                              F.col(a).cast("string").alias("vote"))
                     for i, a in enumerate(annotators)])


def valid_votes(df: DataFrame, id_col: str = "doc_id",
                annotators: Sequence[str] = ANNOTATORS) -> DataFrame:
    """V1: long table (id, annotator_no, annotator, vote) of valid votes
    (blank, null and ``"None"`` skipped)."""
    return df.select(id_col, F.inline(vote_array(annotators))).where(_is_vote(F.col("vote")))


def _stage_votes(df: DataFrame, annotators: Sequence[str]) -> tuple[DataFrame, _Votes, list[str]]:
    """Stage one column per annotator holding its vote or null when it is no
    vote; all later logic compares these plain columns."""
    names = [f"_v{i}" for i in range(len(annotators))]
    staged = df.withColumns({n: F.when(_is_vote(F.col(a).cast("string")), F.col(a).cast("string"))
                             for n, a in zip(names, annotators)})
    return staged, _Votes(names, [f"({n} IS NOT NULL)" for n in names]), names


def _with_majority(df: DataFrame, v: _Votes, out: str) -> DataFrame:
    n = len(v.vals)
    top = _greatest([f"(CASE WHEN {v.valid[i]} THEN {v.cnt[i]} ELSE 0 END)" for i in range(n)])
    staged = df.withColumn("_topn", F.expr(top))
    is_top = [f"({v.valid[i]} AND {v.cnt[i]} = _topn)" for i in range(n)]
    n_top = _count([f"({v.first[i]} AND {is_top[i]})" for i in range(n)])
    maj = "coalesce(" + ", ".join(f"CASE WHEN {is_top[i]} THEN {v.vals[i]} END" for i in range(n)) + ")"
    return (staged.withColumn("n_top", F.expr(n_top))
            .withColumn(out, F.expr(f"CASE WHEN n_top = 1 THEN {maj} END")).drop("_topn"))


def majority_label(df: DataFrame, annotators: Sequence[str] = ANNOTATORS,
                   out: str = "majority") -> DataFrame:
    """V2: add ``out`` = label with strictly most votes (null when tied or no
    vote) and ``n_top`` = number of labels sharing the top count (0: no vote)."""
    staged, v, names = _stage_votes(df, annotators)
    return _with_majority(staged, v, out).drop(*names)


def annotator_reliability(df: DataFrame, annotators: Sequence[str] = ANNOTATORS,
                          taxonomy: Sequence[tuple[str, str]] = TAXONOMY,
                          classes: Sequence[str] = COARSE_LABELS) -> DataFrame:
    """V3: per annotator and coarse class, how often the annotator voted the
    majority label on rows that have one. All combinations present (0 filled).
    One aggregation keyed by the coarse class (a handful of keys, combined
    map-side), then unpivoted to (annotator, coarse_label, n)."""
    spark = df.sparkSession
    staged, v, names = _stage_votes(df, annotators)
    m = _with_majority(staged, v, "majority")
    maj = F.when(F.col("n_top") == 1, F.col("majority"))
    hits = m.groupBy(coarsen(maj, taxonomy=taxonomy).alias("coarse_label")).agg(
        *[F.sum(F.when(F.expr(v.valid[i]) & (F.col(v.vals[i]) == maj), 1).otherwise(0)).cast("long").alias(a)
          for i, a in enumerate(annotators)])
    long = hits.unpivot("coarse_label", list(annotators), "annotator", "n")
    # zero rows for every (annotator, class) by union + sum, not by a join (a
    # join would make Spark infer a not-null filter on the computed class and
    # push it, with the whole majority expression, into the scan)
    zeros = literal_table(spark, [(a, c, 0) for a in annotators for c in classes], ["annotator", "coarse_label", "n"])
    order = literal_table(spark, [(i + 1, a) for i, a in enumerate(annotators)], ["annotator_no", "annotator"])
    full = (zeros.withColumn("n", F.col("n").cast("long")).withColumn("_grid", F.lit(True))
            .unionByName(long.withColumn("n", F.col("n").cast("long")).withColumn("_grid", F.lit(False)))
            .groupBy("annotator", "coarse_label").agg(F.sum("n").cast("long").alias("n"),
                                                      F.max("_grid").alias("_grid"))
            .where(F.col("_grid")))
    return full.join(F.broadcast(order), "annotator").select("annotator_no", "annotator", "coarse_label", "n")


def reliability_columns(reliability: DataFrame, names: Sequence[str], annotators: Sequence[str]) -> DataFrame:
    """The reliability table as one row per coarse class (``_class``) with one
    column of ``names`` per annotator: classes x annotators values."""
    return reliability.groupBy(F.col("coarse_label").alias("_class")).agg(
        *[F.max(F.when(F.col("annotator") == a, F.col("n"))).alias(n) for n, a in zip(names, annotators)])


def resolve_ties(df: DataFrame, reliability: DataFrame, official: str = "official_label",
                 annotators: Sequence[str] = ANNOTATORS,
                 taxonomy: Sequence[tuple[str, str]] = TAXONOMY, out: str = "resolved",
                 rule_col: str | None = None) -> DataFrame:
    """V4: label for undecided rows. Coherent votes (coarse class = official)
    decide: exactly one -> it; several -> most reliable annotator for that
    class (first annotator on equal scores); none -> first available vote.
    The reliability (one row per class) is joined on the official class."""
    df, v, names = _stage_votes(df, annotators)
    n = len(annotators)
    tax = "map(" + ", ".join(f"{_sql_str(f)}, {_sql_str(c)}" for f, c in taxonomy) + ")"
    off = _q(official)
    coh = [f"({v.valid[i]} AND coalesce({tax}[{v.vals[i]}], {v.vals[i]}) = {off})" for i in range(n)]
    rel = [f"_rel{i}" for i in range(n)]
    score = [f"coalesce({r}, CAST(0 AS BIGINT))" for r in rel]
    fallback = "coalesce(" + ", ".join(f"CASE WHEN {v.valid[i]} THEN {v.vals[i]} END" for i in range(n)) + ")"
    flags = [f"_c{i}" for i in range(n)]
    # the first annotator wins equal scores; greatest() skips the nulls of votes that are not coherent
    best = "greatest(" + ", ".join(
        f"CASE WHEN {flags[i]} THEN named_struct('s', {score[i]}, 'i', {-i}, 'v', {v.vals[i]}) END" for i in range(n)) + ").v"
    # a handful of rows by construction (the classes of the taxonomy); null-safe, since a plain
    # equality would make Spark push a not-null filter, with the whole majority expression, into the scan
    joined = (df.join(F.broadcast(reliability_columns(reliability, rel, annotators)), F.col(official).eqNullSafe(F.col("_class")), "left")
              .withColumns({c: F.expr(f"coalesce({e}, false)") for c, e in zip(flags, coh)}).withColumn("_nval", F.expr(v.n_valid)))
    joined = joined.withColumn("_ncoh", F.expr(" + ".join(f"CAST({c} AS INT)" for c in flags)))
    res = joined.withColumn(out, F.expr(f"CASE WHEN _nval = 0 THEN CAST(NULL AS STRING) WHEN _ncoh = 0 THEN {fallback} ELSE {best} END"))
    if rule_col:
        res = res.withColumn(rule_col, F.expr("CASE WHEN _nval = 0 THEN 'no_vote' WHEN _ncoh = 0 THEN 'fallback' "
                                              "WHEN _ncoh = 1 THEN 'single_coherent' ELSE 'reliability' END"))
    return res.drop("_class", *rel, *flags, "_ncoh", "_nval", *names)


def consolidate_votes(df: DataFrame, official: str = "official_label",
                      annotators: Sequence[str] = ANNOTATORS,
                      taxonomy: Sequence[tuple[str, str]] = TAXONOMY,
                      out: str = "evasion_label", with_rule: bool = False) -> DataFrame:
    """V5: majority label, else tie-break by coherence and reliability. The
    table is read twice (once for the reliability aggregate) and never
    shuffled; the reliability (one row per class) reaches the rows by a join."""
    reliability = annotator_reliability(df, annotators, taxonomy)
    m = majority_label(df, annotators, out="_maj")
    r = resolve_ties(m, reliability, official, annotators, taxonomy, out="_res",
                     rule_col="_rule" if with_rule else None)
    r = r.withColumn(out, F.when(F.col("n_top") == 1, F.col("_maj")).otherwise(F.col("_res")))
    if with_rule:
        r = r.withColumn("rule", F.when(F.col("n_top") == 1, F.lit("majority")).otherwise(F.col("_rule")))
    return r.drop("_maj", "_res", "_rule", "n_top")


def gold_label(df: DataFrame, existing: str | None = "evasion_label", official: str = "official_label",
               annotators: Sequence[str] = ANNOTATORS, taxonomy: Sequence[tuple[str, str]] = TAXONOMY,
               out: str = "gold_label") -> DataFrame:
    """V6: an existing valid label wins; else majority among votes inside the
    taxonomy; ties -> first candidate coherent with the official class, else the
    first candidate; no vote -> empty string."""
    labels = [f for f, _ in taxonomy]
    names = [f"_g{i}" for i in range(len(annotators))]
    df = df.withColumns({nm: py_strip(F.coalesce(F.col(a).cast("string"), F.lit("None")))
                         for nm, a in zip(names, annotators)})
    in_tax = "(" + ", ".join(_sql_str(x) for x in labels) + ")"
    v = _Votes(names, [f"({nm} IN {in_tax})" for nm in names])
    n = len(annotators)
    top = _greatest([f"(CASE WHEN {v.valid[i]} THEN {v.cnt[i]} ELSE 0 END)" for i in range(n)])
    staged = df.withColumn("_topn", F.expr(top)).withColumn(
        "_off", py_strip(F.coalesce(F.col(official).cast("string"), F.lit("None"))))
    tax = "map(" + ", ".join(f"{_sql_str(f)}, {_sql_str(c)}" for f, c in taxonomy) + ")"
    cand = [f"({v.first[i]} AND {v.cnt[i]} = _topn)" for i in range(n)]
    first_cand = "coalesce(" + ", ".join(f"CASE WHEN {cand[i]} THEN {names[i]} END" for i in range(n)) + ")"
    first_coh = "coalesce(" + ", ".join(f"CASE WHEN {cand[i]} AND {tax}[{names[i]}] = _off THEN {names[i]} END"
                                        for i in range(n)) + ")"
    from_votes = F.expr(f"CASE WHEN {v.n_valid} = 0 THEN '' WHEN {_count(cand)} = 1 THEN {first_cand} "
                        f"ELSE coalesce({first_coh}, {first_cand}) END")
    if existing is not None and existing in df.columns:
        ex = py_strip(F.coalesce(F.col(existing).cast("string"), F.lit("None")))
        from_votes = F.when(ex.isin(labels), ex).otherwise(from_votes)
    return staged.withColumn(out, from_votes).drop("_topn", "_off", *names)


# --- label filters and lookups -------------------------------------------------

def keep_labelled(df: DataFrame, col: str) -> DataFrame:
    """Rows with a non-null, non-blank label; the label is stripped."""
    return df.where(F.col(col).isNotNull() & (py_strip(col) != "")).withColumn(col, py_strip(col))


def keep_nonnull(df: DataFrame, col: str, rename: str | None = None) -> DataFrame:
    """Rows whose label is not null (blank passes); optional rename."""
    out = df.where(F.col(col).isNotNull())
    return out.withColumnRenamed(col, rename) if rename else out


def apply_label_ids(df: DataFrame, label_map: DataFrame, col: str, out: str = "label") -> DataFrame:
    """P10 as a join: label -> id through a label map table (label, label_id) of
    any size; unknown or missing -> -100, the smallest id of a label listed twice.
    Spark's size check decides how the map is sent."""
    m = label_map.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("_lbl")).agg(F.min("label_id").alias("_lid"))
    return (df.join(m, F.col(col) == F.col("_lbl"), "left")
            .withColumn(out, F.coalesce(F.col("_lid"), F.lit(-100)).cast("int"))
            .drop("_lbl", "_lid"))


def select_for_task(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep only the listed columns (those present)."""
    return df.select(*[c for c in cols if c in df.columns])


def take_split(df: DataFrame, name: str, split_col: str = "split") -> DataFrame:
    """Rows of one split (prunes partitions when stored by split)."""
    return df.where(F.col(split_col) == name)


FINE = FINE_LABELS
