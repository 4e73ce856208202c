"""Vote consolidation: every branch with hand-made rows."""
from answerlab.operators import votes as V
from conftest import rows
from pyspark.sql import functions as F

SCHEMA = "doc_id long, annotator1 string, annotator2 string, annotator3 string, official_label string"


def test_valid_votes_skip_blank_null_none(spark):
    df = spark.createDataFrame([(1, "Explicit", "  ", None), (2, "None", " None ", "Dodging")], SCHEMA.replace(
        ", official_label string", ""))
    assert rows(V.valid_votes(df), "doc_id", "annotator_no", "vote") == [(1, 1, "Explicit"), (2, 3, "Dodging")]


def test_majority_and_ties(spark):
    df = spark.createDataFrame([
        (1, "Explicit", "Explicit", "Dodging", "Clear Reply"),   # majority
        (2, "Explicit", "Dodging", "General", "Ambivalent"),     # 1-1-1 tie
        (3, "Explicit", "", None, "Clear Reply"),                # single vote = majority
        (4, None, "", "None", "Clear Reply"),                    # no vote
    ], SCHEMA)
    out = rows(V.majority_label(df), "doc_id", "n_top", "majority")
    assert out == [(1, 1, "Explicit"), (2, 3, None), (3, 1, "Explicit"), (4, 0, None)]


def test_resolve_ties_branches(spark):
    # reliability: annotator3 agrees with the majority on an Ambivalent row
    df = spark.createDataFrame([
        (10, "General", "General", "General", "Ambivalent"),      # majority rows feeding reliability
        (11, "Dodging", "Deflection", "Deflection", "Ambivalent"),
        (1, "Explicit", "Dodging", "Claims ignorance", "Ambivalent"),   # one coherent vote -> Dodging
        (2, "Dodging", "General", "Explicit", "Ambivalent"),            # two coherent -> most reliable (annotator2)
        (3, "Explicit", "Clarification", "Declining to answer", "Ambivalent"),  # none coherent -> first vote
    ], SCHEMA)
    out = {r["doc_id"]: (r["evasion_label"], r["rule"]) for r in V.consolidate_votes(df, with_rule=True).collect()}
    assert out[1] == ("Dodging", "single_coherent")
    assert out[2] == ("General", "reliability")
    assert out[3] == ("Explicit", "fallback")
    assert out[10] == ("General", "majority")


def test_equal_reliability_first_annotator_wins(spark):
    df = spark.createDataFrame([(1, "Dodging", "General", "Explicit", "Ambivalent")], SCHEMA)
    out = V.consolidate_votes(df).collect()[0]["evasion_label"]
    assert out == "Dodging"  # all scores 0 -> first coherent annotator


def test_gold_label_existing_and_empty(spark):
    df = spark.createDataFrame([
        (1, "Dodging", "General", "Explicit", "Clear Reply", " Implicit "),
        (2, "Dodging", "General", "x", "Ambivalent", None),
        (3, "x", "", None, "Ambivalent", "bad"),
        (4, "Explicit", "General", "x", "Clear Non-Reply", None),
    ], SCHEMA + ", evasion_label string")
    out = dict((r["doc_id"], r["gold_label"]) for r in V.gold_label(df).collect())
    assert out == {1: "Implicit", 2: "Dodging", 3: "", 4: "Explicit"}


def test_reliability_has_all_cells(spark):
    df = spark.createDataFrame([(1, "Explicit", "Explicit", "Dodging", "Clear Reply")], SCHEMA)
    rel = rows(V.annotator_reliability(df), "annotator", "coarse_label", "n")
    assert len(rel) == 9
    assert ("annotator1", "Clear Reply", 1) in rel and ("annotator3", "Clear Reply", 0) in rel


def test_label_ids_by_table(spark):
    from answerlab.operators.votes import apply_label_ids
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "x"), (5, "a")], "id long, c string")
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("b", 7), (None, 3)], "label string, label_id int")
    assert sorted(map(tuple, apply_label_ids(df, ids, "c").select("id", "label").collect())) == [(1, 0), (2, 1), (3, -100), (4, -100), (5, 0)]
    many = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("label"), F.col("id").cast("int").alias("label_id"))
    wide = spark.range(2000).select("id", F.concat(F.lit("k"), F.col("id") * 25).alias("c"))
    assert apply_label_ids(wide, many, "c").where("label = id * 25").count() == 2000


def test_csv_files_are_bounded(spark, tmp_path):
    from answerlab.sources import io as IO
    df = spark.range(1000).select(F.col("id").cast("string").alias("question"), F.lit("a\nb").alias("answer_snippet"))
    IO.write_predictions(df.coalesce(1), str(tmp_path / "p"), "csv", None, csv_rows=300)
    assert len(list((tmp_path / "p").glob("part-*.csv"))) == 4
    assert IO.read_predictions(spark, str(tmp_path / "p"), "question string, answer_snippet string").where("answer_snippet = 'a\\nb'").count() == 1000


def test_a_failing_row_costs_its_batch_few_calls(spark):
    import pandas as pd

    from answerlab.operators.scoring import _replies
    calls = []
    def scorer(pdf):
        calls.append(len(pdf))
        if (pdf.id == 77).any():
            raise ValueError("no")
        return pdf.id.astype(str)
    got = _replies(scorer, pd.DataFrame({"id": range(128)}))
    assert got[77] == "ERROR: no" and [g for i, g in enumerate(got) if i != 77] == [str(i) for i in range(128) if i != 77]
    assert len(calls) <= 2 * 8 and sum(calls) < 4 * 128
