"""Prompt tables (X8-X10): text assembly as native string expressions.

Templates are data (a parameter list or a table), never code; example blocks
are assembled per query from at most k rows, in rank order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.functions.text import truncate_chars

# --- fixed values: layout of one example block and of the user turn ---
EXAMPLE_HEAD = "Example {i}:\n"
BLOCK_LAYOUT = ("QUESTION: ", "\nANSWER: ", "\nCLASSIFICATION: ")
USER_LAYOUT = ("QUESTION: ", "\n\nANSWER: ")
TUNING_USER_LAYOUT = ("Question: ", "\nPolitician answer: ")


def example_block(question: Column, answer: Column, label: Column, max_answer: int | None = 1500) -> Column:
    """One ``QUESTION / ANSWER / CLASSIFICATION`` block; with ``max_answer`` the
    answer is cut with ``...`` (dynamic prompts), without it kept whole."""
    a = truncate_chars(answer, max_answer, ellipsis=True) if max_answer else answer
    q_, a_, c_ = BLOCK_LAYOUT
    return F.concat(F.lit(q_), question, F.lit(a_), a, F.lit(c_), label)


def format_examples(rows: DataFrame, group: Sequence[str], rank: str, question: str, answer: str, label: str,
                    header: str, tail: str, max_answer: int | None = 1500, out: str = "system_prompt") -> DataFrame:
    """Per group, ``header`` + ``Example i:`` blocks in rank order + ``tail``."""
    blocks = F.array_sort(F.collect_list(F.struct(
        F.col(rank).alias("r"), example_block(F.col(question), F.col(answer), F.col(label), max_answer).alias("b"))))
    numbered = F.transform(blocks, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"),
                                                         x["b"], F.lit("\n\n")))
    return rows.groupBy(*group).agg(F.concat(F.lit(header), F.array_join(numbered, ""), F.lit(tail)).alias(out))


def user_text(question: Column, answer: Column) -> Column:
    q_, a_ = USER_LAYOUT
    return F.concat(F.lit(q_), question, F.lit(a_), answer)


def prompt_table(df: DataFrame, templates: Sequence[tuple[str, str]], question: str, answer: str) -> DataFrame:
    """One row per (row, run): the run's system text and the user text.
    ``templates`` is the list of (run_id, system_text); it is attached by a
    generator per row, so there is no join."""
    arr = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(t).alias("system_prompt")) for r, t in templates])
    return (df.select("*", F.inline(arr))
            .withColumn("user_prompt", user_text(F.col(question), F.col(answer))))


def prompt_table_dynamic(df: DataFrame, prompts: DataFrame, keys: Sequence[str], question: str, answer: str) -> DataFrame:
    """X9 (per-row system text, e.g. from X8): join on the row keys."""
    return df.join(prompts, list(keys)).withColumn("user_prompt", user_text(F.col(question), F.col(answer)))


def training_texts(df: DataFrame, system: str, question: str, answer: str, label: str,
                   default_label: str | None = None, out: str = "messages") -> DataFrame:
    """System / user / assistant turns as a JSON array of {role, content}."""
    lbl = F.col(label).cast("string")
    if default_label is not None:
        lbl = F.coalesce(lbl, F.lit(default_label))
    q_, a_ = TUNING_USER_LAYOUT
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(F.lit(q_), F.col(question), F.lit(a_), F.col(answer)).alias("content")),
        F.struct(F.lit("assistant").alias("role"), lbl.alias("content")))
    return df.withColumn(out, F.to_json(msgs))
