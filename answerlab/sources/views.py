"""Derived fixture views (see FIXTURES.md), built with the DataFrame API.

Each view is a pure function of the driver tables, so its size grows with
the scale factor. The DuckDB text of the same views lives in
``answerlab.plans.oracle_views`` and is written independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlab.functions.constants import COARSE_LABELS, FINE_LABELS, TAXONOMY
from answerlab.session import literal_table
from answerlab.sources.tables import table

SPLIT_SEED = 42


def _fine_at(pos: Column) -> Column:
    """Fine label at taxonomy position ``pos`` (0-based); null outside."""
    # guarded: element_at on a literal array with a null index does not give null
    return F.when(pos.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in FINE_LABELS]), (pos + 1).cast("int")))


def _coarse_of_pos(pos: Column) -> Column:
    return F.when(pos.isNotNull(), F.element_at(F.array(*[F.lit(c) for _, c in TAXONOMY]), (pos + 1).cast("int")))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(pos, label, coarse): the nine fine labels with their coarse class."""
    return literal_table(spark, [(i, f, c) for i, (f, c) in enumerate(TAXONOMY)], ["pos", "label", "coarse"])


def coarse_labels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(i, c) for i, c in enumerate(COARSE_LABELS)], ["pos", "label"])


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """v_votes: three annotator votes per document with blanks, nulls and ties.
    Label names come from broadcast joins with the 9-row taxonomy (as stored
    columns would), so later expressions see plain columns."""
    d = F.col("doc_id")
    p1 = d % 9
    p2 = F.when(d % 4 == 1, (d + 1) % 9).when(d % 11 == 3, F.lit(-1)).otherwise(d % 9)
    p3 = (F.when(d % 4 == 1, (d + 2) % 9).when(d % 4 == 2, (d + 4) % 9)
          .when(d % 7 == 5, F.lit(None)).otherwise(d % 9))
    pc = (d + d % 3) % 9
    pos = table(spark, sf, "documents").select("doc_id", p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), pc.alias("pc"))
    tax = taxonomy(spark)

    def lookup(df, key, out, col="label", how="left"):
        t = F.broadcast(tax.select(F.col("pos").alias(key), F.col(col).alias(out)))
        return df.join(t, key, how)

    j = lookup(lookup(lookup(lookup(pos, "p1", "annotator1"), "p2", "_a2"), "p3", "annotator3"),
               "pc", "official_label", "coarse")
    return j.select("doc_id", "annotator1",
                    F.when(F.col("p2") == -1, F.lit("")).otherwise(F.col("_a2")).alias("annotator2"),
                    "annotator3", "official_label")


_SHIFT = {"en": "fr", "fr": "de", "de": "es"}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """v_predictions: language as truth, a shifted language as some predictions."""
    lang = F.col("lang")
    shifted = F.coalesce(F.create_map(*[F.lit(x) for kv in _SHIFT.items() for x in kv])[lang], F.lit("en"))
    pred = (F.when(F.col("doc_id") % 37 == 0, F.lit("PARSE_ERROR"))
            .when(F.col("doc_id") % 5 == 0, shifted).otherwise(lang))
    return table(spark, sf, "documents").select("doc_id", lang.alias("true_label"), pred.alias("pred_label"))


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """v_qa: user turn followed by an assistant turn of the same conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    return (c.select("conv_id", "turn", "role", F.col("text").alias("question"),
                     F.lead("role").over(w).alias("next_role"),
                     F.lead("text").over(w).alias("answer"))
            .where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select("conv_id", "turn", "question", "answer"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """v_questions: one of twelve question openings around the whole user turn."""
    s = F.col("s")
    k = (F.col("conv_id") + F.col("turn")) % 12
    q = (F.when(k == 0, F.concat(F.lit("Will you "), s, F.lit("?")))
         .when(k == 1, F.concat(F.lit("What is "), s, F.lit("?")))
         .when(k == 2, F.concat(F.lit("Why "), s, F.lit("? And how do you "), s, F.lit("?")))
         .when(k == 3, F.concat(F.lit("When "), s, F.lit("?")))
         .when(k == 4, F.concat(F.lit("Who "), s, F.lit(" and do you "), s, F.lit("?")))
         .when(k == 5, F.concat(F.lit("How many "), s, F.lit("?")))
         .when(k == 6, F.concat(F.lit("How do you feel "), s, F.lit("?")))
         .when(k == 7, F.concat(F.lit("what caused "), s, F.lit("?")))
         .when(k == 8, F.lit("So?"))
         .when(k == 9, F.concat(F.lit("Q. And is "), s, F.lit("? Yes? Can "), s, F.lit("?")))
         .when(k == 10, F.concat(F.lit("  What   date "), s, F.lit("?")))
         .otherwise(s))
    return (qa(spark, sf).select("conv_id", "turn", F.col("question").alias("s"), "answer")
            .select("conv_id", "turn", q.alias("question"), "answer"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """v_replies: twelve shapes of raw model replies, around the document's text."""
    k = F.col("doc_id") % 12
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = (F.when(k == 0, F.lit("Explicit"))
           .when(k == 1, F.lit(" clear non reply "))
           .when(k == 2, F.concat(F.lit("I think: Dodging, not General. "), text))
           .when(k == 3, F.lit(""))
           .when(k == 4, F.concat(F.lit("<step1>"), text, F.lit("</step1><step2>\u00a0b\u2003</step2><label>\u00a0General </label>")))
           .when(k == 5, F.concat(F.lit("<label>none</label>\n"), text, F.lit("\n\u3000Deflection")))
           .when(k == 6, F.lit('{"category": "Claims ignorance"}'))
           .when(k == 7, F.lit('x {"label": "Implicit"} y'))
           .when((k == 8) & (F.col("doc_id") % 24 == 8), F.lit('{"category": null, "label": "Implicit"}'))
           .when(k == 8, F.lit('{"category": broken Clarification}'))
           .when(k == 9, F.lit("half-answer"))
           .when(k == 10, F.lit("non-reply"))
           .otherwise(text))
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


def split_hash(id_col: Column, seed: int = SPLIT_SEED) -> Column:
    """Stateless uniform value in [0, 1) from an id and a seed (md5 based)."""
    hexpart = F.substring(F.md5(F.concat(id_col.cast("string"), F.lit(f"|{seed}"))), 1, 8)
    return F.conv(hexpart, 16, 10).cast("double") / F.lit(4294967296.0)


def split(spark: SparkSession, sf: str, test_size: float = 0.2, seed: int = SPLIT_SEED) -> DataFrame:
    """v_split: documents with a train/validation tag; language is the label."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", F.col("lang").alias("label"), "source",
                    F.when(split_hash(F.col("doc_id"), seed) < test_size, F.lit("validation"))
                    .otherwise(F.lit("train")).alias("split"))


def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    """v_text_labels: documents with their quality and toxicity labels."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def vectors_q(spark: SparkSession, sf: str) -> DataFrame:
    """v_vectors_q: embeddings in the validation part of the hash split (queries)."""
    return table(spark, sf, "embeddings").where(split_hash(F.col("vec_id")) < 0.2)


def vectors_c(spark: SparkSession, sf: str) -> DataFrame:
    """v_vectors_c: embeddings in the train part of the hash split (corpus)."""
    return table(spark, sf, "embeddings").where(split_hash(F.col("vec_id")) >= 0.2)


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """v_examples: documents as labelled QA rows: question from the source tag,
    answer = text, gold fine label (vote consolidation) and official coarse
    label, plus the hash split."""
    from answerlab.operators.votes import consolidate_votes
    gold = consolidate_votes(votes(spark, sf)).select("doc_id", "evasion_label", "official_label")
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("What does "), F.col("source"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"), "lang")
    return (d.join(gold, "doc_id")
            .withColumn("split", F.when(split_hash(F.col("doc_id")) < 0.2, F.lit("validation")).otherwise(F.lit("train"))))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """v_logits: four logits and a label id (-100 = ignore) per document."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 13 == 0, F.lit(-100)).otherwise(d % 4).cast("int").alias("label_id"),
        F.array(*[(((d * k) % 17) / F.lit(4.0)).cast("double") for k in range(1, 5)]).alias("logits"),
    )


def sub_answers(spark: SparkSession, sf: str) -> DataFrame:
    """v_sub_answers: one to three labelled parts per document plus a direct label."""
    d = F.col("doc_id")
    return (table(spark, sf, "documents").select("doc_id")
            .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), d % 3)).alias("part"))
            .select("doc_id", F.col("part").cast("int").alias("part"),
                    _fine_at((d * (F.col("part") + 1)) % 9).alias("label"),
                    _fine_at((d + 2) % 9).alias("direct_label")))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """v_clusters: embeddings with a given cluster id and a class."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", (F.col("vec_id") % 5).cast("int").alias("cluster"),
        (F.col("label") % 3).cast("int").alias("class"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """v_candidates: four rewrite attempts per document with an accept flag."""
    d = F.col("doc_id")
    return (table(spark, sf, "documents").select("doc_id", "text", "lang")
            .select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
            .select("doc_id", "lang", "attempt",
                    ((d * 7 + F.col("attempt") * 3) % 5 == 0).alias("accepted"),
                    F.expr("substr(text, attempt + 1)").alias("rewrite")))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """v_pairs: each document with the document that follows its id."""
    docs = table(spark, sf, "documents")
    a = docs.select("doc_id", F.col("text").alias("original"))
    b = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("rewrite"))
    return a.join(b, "doc_id")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """v_articles: first word of each document (punctuation removed) as a title,
    text of the lowest doc_id with that title as the article."""
    first = F.regexp_replace(F.element_at(F.split(F.trim(F.col("text")), r"\s+"), 1), r"(?U)[^\p{L}\p{N}_\s]", "")
    return (table(spark, sf, "documents").select(first.alias("title"), "doc_id", "text")
            .where(F.col("title") != "")
            .groupBy("title").agg(F.min_by("text", "doc_id").alias("article")))


def lexicon(spark: SparkSession) -> DataFrame:
    """v_lexicon: a small user word list (parameter table)."""
    return literal_table(spark, [("the", "Assertive", 1.0), ("than", "Guarded", 1.0), ("and", "Dismissive", 1.0),
                                 ("la", "Guarded", 0.5), ("in", "Assertive", 0.5)], ["word", "tone", "weight"])


def done(spark: SparkSession, sf: str) -> DataFrame:
    """v_done: ids already scored."""
    return table(spark, sf, "documents").select("doc_id").where(F.col("doc_id") % 3 == 0)


_EVENT_SHIFT = {"view": "click", "click": "purchase", "purchase": "signup", "signup": "error", "error": "view"}


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """v_scored_events: event type as truth, a shifted type for every fourth event."""
    et = F.col("event_type")
    shifted = F.create_map(*[F.lit(x) for kv in _EVENT_SHIFT.items() for x in kv])[et]
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), et.alias("true_label"),
        F.when(F.col("event_id") % 4 == 0, shifted).otherwise(et).alias("pred_label"))


def balance_rows(spark: SparkSession, sf: str) -> DataFrame:
    """v_balance: embeddings as labelled rows for rebalancing: three classes of
    unequal size from the embedding label (0-5, 6-8, 9), the document text of
    the same id (empty when there is none) and the hash split."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    cls = F.when(F.col("label") < 6, 0).when(F.col("label") < 9, 1).otherwise(2)
    return (e.join(d, "vec_id", "left")
            .select(F.col("vec_id").alias("doc_id"), "embedding", cls.alias("class"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                    F.when(split_hash(F.col("vec_id")) < 0.2, F.lit("validation")).otherwise(F.lit("train")).alias("split")))
