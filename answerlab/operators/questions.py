"""Question context and sub-question aggregation (Q3, Q4, Q8, Q9, Q10).

Q3 explodes at most five entities per question, joins an article table on the
entity (Catalyst/AQE choose broadcast or sort-merge by size; AQE splits a hot
entity), and rebuilds the context per question from an array of at most five
snippets. Q8/Q10 aggregate the parts of one question: partial counts per
(question, label) first, so a question with many parts costs no more than its
label count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.functions.constants import CONTEXT_HEADER, TAXONOMY
from answerlab.functions.labels import coarsen
from answerlab.functions.questions import question_type, with_candidate_entities
from answerlab.functions.text import py_strip


def summary_sentences(article, sentences: int = 3):
    """First ``sentences`` pieces split on ``. ``, stripped, final dot ensured."""
    short = py_strip(F.array_join(F.slice(F.split(article, r"\. "), 1, sentences), ". "))
    return F.when(article.isNull(), F.lit(None)).when(short.endswith("."), short).otherwise(F.concat(short, F.lit(".")))


def attach_context(questions: DataFrame, articles: DataFrame, id_cols: Sequence[str], question: str = "question",
                   max_chars: int = 600, sentences: int = 3, out: str = "rag_context") -> DataFrame:
    """Q3: per question, ``[entity]: summary`` lines for its entities in order,
    stopping before an entity once the text so far reaches ``max_chars``; a
    header line in front; empty when nothing is found."""
    ids = list(id_cols)
    # outer explode: a plain explode makes Spark infer size(array) > 0 and push
    # that filter, with the whole entity expression, below the projection
    ents = (with_candidate_entities(questions.select(*ids, question), question, "_ents")
            .select(*ids, F.posexplode_outer("_ents").alias("pos", "entity"))
            .where(F.col("entity").isNotNull()))
    arts = articles.select(F.col("title").alias("entity"), summary_sentences(F.col("article"), sentences).alias("summary"))
    snips = (ents.join(arts, "entity")
             .select(*ids, "pos", F.concat(F.lit("["), F.col("entity"), F.lit("]: "), F.col("summary")).alias("snippet")))
    per_q = snips.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", "snippet"))).alias("_s"))
    # running length before each snippet; keep while it is below the budget
    kept = F.aggregate(
        F.col("_s"),
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(acc["total"] < max_chars, F.struct(
            (acc["total"] + F.char_length(x["snippet"])).cast("long").alias("total"),
            F.array_append(acc["parts"], x["snippet"]).alias("parts"))).otherwise(acc))
    ctx = per_q.select(*ids, F.concat(F.lit(CONTEXT_HEADER + "\n"), F.array_join(kept["parts"], "\n")).alias(out))
    return (questions.join(ctx, ids, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(""))))


def question_context_message(df: DataFrame, question: str = "question", answer: str = "answer",
                             context: str | None = "rag_context", out: str = "user_message") -> DataFrame:
    """Q4: optional context block, question type, expectation, question, answer."""
    qt = question_type(question)
    parts = []
    if context is not None:
        ctx = F.coalesce(F.col(context), F.lit(""))
        parts.append(F.when(ctx != "", F.concat(ctx, F.lit("\n"))))
    parts += [F.concat(F.lit("QUESTION TYPE: "), F.upper(qt["question_type"])),
              F.concat(F.lit("RESPONSE EXPECTATION: "), qt["hint"]), F.lit(""),
              F.concat(F.lit("QUESTION: "), F.col(question)),
              F.concat(F.lit("\nANSWER: "), F.col(answer))]
    return df.withColumn(out, F.concat_ws("\n", *parts))


def aggregate_sub_answers(parts: DataFrame, id_cols: Sequence[str], label: str = "label", order: str = "part",
                          taxonomy: Sequence[tuple[str, str]] = TAXONOMY, out: str = "final_label") -> DataFrame:
    """Q8: one label per question from the labels of its sub-questions."""
    ids = list(id_cols)
    labels = [f for f, _ in taxonomy]
    per_label = parts.groupBy(*ids, F.col(label).alias("_l")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    agg = per_label.groupBy(*ids).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_l") == "Explicit", F.col("_n")).otherwise(0)).alias("n_explicit"),
        F.sum(F.when(F.col("_l") == "Declining to answer", F.col("_n")).otherwise(0)).alias("n_declining"),
        F.sum(F.when(F.col("_l") == "Claims ignorance", F.col("_n")).otherwise(0)).alias("n_ignorance"),
        F.max_by("_l", F.struct(F.col("_n"), -F.col("_first"))).alias("most_common"))
    n, ne = F.col("n"), F.col("n_explicit")
    nd, ni = F.col("n_declining"), F.col("n_ignorance")
    final = (F.when(n == 1, F.col("most_common"))
             .when(ne == n, F.lit("Explicit"))
             .when((n >= 3) & (ne / n >= 0.67), F.lit("Explicit"))
             .when(nd + ni == n, F.when(nd >= ni, F.lit("Declining to answer")).otherwise(F.lit("Claims ignorance")))
             .when(ne > 0, F.lit("Partial/half-answer"))
             .otherwise(F.col("most_common")))
    return agg.select(*ids, "n", F.when(final.isin(labels), final).otherwise(F.lit("Dodging")).alias(out))


def hybrid_label(final: str, direct: str, taxonomy: Sequence[tuple[str, str]] = TAXONOMY):
    """Q9: if the aggregated label is Ambivalent but the direct label is a
    clear class, take the direct label. Returns (label column, coarse column)."""
    cf = coarsen(F.col(final), default=None, taxonomy=taxonomy)
    cd = coarsen(F.col(direct), default=None, taxonomy=taxonomy)
    lbl = F.when((cf == "Ambivalent") & cd.isin("Clear Reply", "Clear Non-Reply"), F.col(direct)).otherwise(F.col(final))
    return lbl, coarsen(lbl, default=None, taxonomy=taxonomy)


def split_log(parts: DataFrame, id_cols: Sequence[str], order: str = "part", label: str = "label",
              extra: Sequence[str] = (), lists: dict[str, str] | None = None, final: str | None = None) -> DataFrame:
    """Q10: one audit row per question with its labels in part order (JSON).
    ``lists`` names further columns of the parts (sub-questions, raw outputs) to
    be listed the same way, ``extra`` columns that are the same in all parts
    (splitter source, direct label), ``final`` the column for the label that Q8
    gives the question."""
    ids, listed = list(id_cols), {"labels": label, **(lists or {})}
    kept = [f"_p{i}" for i in range(len(listed))]
    parted = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(k) for k, c in zip(kept, listed.values())])))
    out = parts.groupBy(*ids).agg(parted.alias("_all"), *[F.any_value(c).alias(c) for c in extra])
    out = out.withColumns({name: F.to_json(F.col(f"_all.{k}")) for name, k in zip(listed, kept)}).drop("_all")
    return out if final is None else out.join(aggregate_sub_answers(parts, ids, label, order, out=final).drop("n"), ids)
