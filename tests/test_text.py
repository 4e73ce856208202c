"""Text, reply and question rules on hand-made strings."""
import pytest
from pyspark.sql import functions as F

from answerlab.functions import questions as QF
from answerlab.functions import replies as RF
from answerlab.functions import text as T
from answerlab.functions.constants import COARSE_LABELS, FINE_LABELS


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).collect()[0]["o"]


@pytest.mark.parametrize("value,expected", [(None, 0), ("", 0), ("  a\tb\n c  ", 3), ("None", 1)])
def test_word_count(spark, value, expected):
    assert one(spark, T.word_count("s"), value) == expected


def test_truncate_words_default_and_cut(spark):
    assert one(spark, T.truncate_words("s", 2), None) == "Unknown"
    assert one(spark, T.truncate_words("s", 2), "") == "Unknown"
    assert one(spark, T.truncate_words("s", 2), " a  b c ") == "a b"


def test_truncate_chars_and_prefix(spark):
    assert one(spark, T.truncate_chars("s", 3), "abcd") == "abc..."
    assert one(spark, T.truncate_chars("s", 4), "abcd") == "abcd"
    df = spark.createDataFrame([("ans", "Guarded", None), ("ans", "", "")], "a string, t string, l string")
    out = [r["o"] for r in df.select(T.feature_prefix("a", "t", "l").alias("o")).collect()]
    assert out == ["Tone: Guarded | Answer: ans", "ans"]


@pytest.mark.parametrize("raw,fine,coarse", [
    ("Explicit", "Explicit", "PARSE_ERROR"),
    (" clear non reply ", "PARSE_ERROR", "Clear Non-Reply"),
    ("", "Explicit", "Clear Reply"),                 # empty reply is contained in the first label
    ("partial answer (a+b)*?", "Partial/half-answer", "PARSE_ERROR"),
    ("it is ambivalent\nreally", "PARSE_ERROR", "Ambivalent"),
])
def test_normalise_label(spark, raw, fine, coarse):
    assert one(spark, RF.normalise_label("s", FINE_LABELS), raw) == fine
    assert one(spark, RF.normalise_label("s", COARSE_LABELS), raw) == coarse


def test_normalise_tagged_and_steps(spark):
    raw = "<step1> a </step1><step2>b</step2>\n<LABEL> dodging </label>"
    assert one(spark, RF.normalise_tagged("s", FINE_LABELS), raw) == "Dodging"
    assert one(spark, RF.reasoning_steps("s"), raw) == "a | b"
    assert one(spark, RF.normalise_tagged("s", FINE_LABELS), "x\nnothing\nGeneral") == "General"


@pytest.mark.parametrize("raw,expected", [
    ('{"category": " Implicit "}', "Implicit"), ('pre {"categoria": "General"} post', "General"),
    ('{"label": "Explicit"', "Explicit"), ("[1, 2] dodging", "Dodging"), ("nothing", None),
    ('{"other": 1} and Deflection', "Deflection"),
])
def test_category_from_json(spark, raw, expected):
    assert one(spark, RF.category_from_json("s"), raw) == expected


def test_question_type_order(spark):
    cases = {"Do you think so?": "yes_no", "what do you think": "opinion", "What caused it": "why",
             "What is your plan": "factual", "  WHEN   is it": "when", "How many": "quantitative", "Tell me": "open"}
    for q, t in cases.items():
        assert one(spark, QF.question_type("s")["question_type"], q) == t


def test_candidate_entities_order_and_overlap(spark):
    q = "Will you invite the New York Times, Obama and Obama to the White House?"
    ents = one(spark, QF.candidate_entities("s"), q)
    # candidates overlap, take up to two following capitalised tokens, keep order, first five
    assert ents == ["New York Times", "York Times Obama", "Times Obama", "Obama", "White House"]
    assert one(spark, QF.candidate_entities("s"), "Single") == []


def test_rule_split(spark):
    out = one(spark, QF.rule_split("s"), "Q. And is it true? Yes? Can you say why it is?")
    assert out == ["Is it true?", "Can you say why it is?"]
    out2 = one(spark, QF.rule_split("s"), "Who did this and do you agree with it")
    # "Who did this" is cut to "Did this" (first starter) and dropped for having under 3 words
    assert out2 == ["Do you agree with it"]
    assert one(spark, QF.rule_split("s"), "So?") == ["So?"]


def test_white_space_is_pythons(spark):
    for text in ("a\u00a0b", "\u2003x y\x1cz \u3000", "\x85q", "", "\u200bq r"):
        assert one(spark, T.word_count("s"), text) == len(text.split())
        assert one(spark, T.py_strip("s"), text) == text.strip()


def test_json_key_with_null_counts_as_present(spark):
    assert one(spark, RF.category_from_json("s"), '{"category": null, "label": "Implicit"}') == "None"
    assert one(spark, RF.category_from_json("s"), '{"category": true}') == "True"
    assert one(spark, RF.contained_label("s"), "Dodging, not General") == "Dodging"
    df = QF.with_route_split(spark.createDataFrame([("one two three four five six seven eight", '{"sub_questions": null}')], "q string, r string"), "q", "r")
    assert df.first()["split"]["splitter_source"] == "llm_base"
