"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the stage's
result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents`` (``n_chars`` follows the text).

Null texts fail the quality rules; a document whose lines are all later copies
goes with them; empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from answerlab.llm.common import read, stored
from answerlab.session import ship_package


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limits go, and the documents that the rules reject."""
    return _sized(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left."""
    ship_package(spark)
    done = line_dedup.dedup_lines(docs)
    return _sized(done.where("n_lines = 0 or n_removed_lines < n_lines").select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences in the sources' proportions."""
    ship_package(spark)
    return packing.digest(docs, _tokenizer())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near),
          ("decontamination", decontaminated), ("packing", packed)]

#: SQL cannot express the tokenizer or the near-duplicate search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
