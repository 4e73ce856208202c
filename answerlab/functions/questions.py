"""Question rules as column expressions (Q1, Q2, Q5, Q6, Q7).

Word boundaries and word characters are Unicode-aware (``(?U)``), as in
Python's ``re`` on str.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlab.functions.constants import (QUESTION_TYPE_DEFAULT, QUESTION_TYPES, RULE_SPLIT_MARK,
                                           SHORT_SPLIT_MARK, STARTER_WORDS)
from answerlab.functions.text import SPACE, py_strip, word_count, words

ColumnOrName = Column | str

STARTERS = "|".join(STARTER_WORDS)
STARTER_RE = rf"(?iU)\b({STARTERS})\b"
CONNECTOR_RE = rf"(?U){SPACE}+(?=(?:And|and){SPACE}+(?:{STARTERS})\b)"
NON_WORD_RE = r"(?U)[^\w\s]"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised_question(q: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(py_strip(_c(q))), rf"(?U){SPACE}+", " ")


def question_type(q: ColumnOrName) -> Column:
    """Q1: struct(question_type, expected_length, hint); first rule that
    matches the start of the lower-cased, blank-collapsed question wins."""
    n = normalised_question(q)
    d_type, d_len, d_hint = QUESTION_TYPE_DEFAULT
    out = None
    for qtype, pattern, length, hint in QUESTION_TYPES:
        val = F.struct(F.lit(qtype).alias("question_type"), F.lit(length).alias("expected_length"),
                       F.lit(hint).alias("hint"))
        cond = n.rlike(pattern)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.struct(F.lit(d_type).alias("question_type"), F.lit(d_len).alias("expected_length"),
                                  F.lit(d_hint).alias("hint")))


def _is_upper_first(x: Column) -> Column:
    return (x != "") & F.substring(x, 1, 1).rlike(r"^\p{Lu}")


def entity_tokens(q: ColumnOrName) -> Column:
    """Whitespace tokens of the question with punctuation removed (Q2 input)."""
    return F.transform(words(py_strip(_c(q))), lambda w: F.regexp_replace(w, NON_WORD_RE, ""))


def entities_from_tokens(toks: ColumnOrName, limit: int = 5) -> Column:
    """Q2 on a staged token column: after the first token, each capitalised
    token (length > 1) starts a candidate that takes up to two following
    capitalised tokens; order-preserving distinct, first ``limit``. The token
    array must be a column (not an expression), so the lambda reads it
    instead of recomputing it per element."""
    toks = _c(toks)
    n = F.size(toks)

    def cand(w, i):
        nxt = F.when(i + 1 < n, F.try_element_at(toks, (i + 2).cast("int")))
        nxt2 = F.when(i + 2 < n, F.try_element_at(toks, (i + 3).cast("int")))
        two = F.coalesce(_is_upper_first(nxt), F.lit(False))
        three = two & F.coalesce(_is_upper_first(nxt2), F.lit(False))
        ent = (F.when(three, F.concat_ws(" ", w, nxt, nxt2)).when(two, F.concat_ws(" ", w, nxt)).otherwise(w))
        return F.when((i >= 1) & _is_upper_first(w) & (F.char_length(w) > 1), ent)

    cands = F.filter(F.transform(toks, cand), lambda x: x.isNotNull())
    return F.when(n <= 1, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(cands), 1, limit))


def with_candidate_entities(df, q: str, out: str = "entities", limit: int = 5):
    """Q2 on a DataFrame: tokens staged as a column, then the candidates."""
    return df.withColumn("_etoks", entity_tokens(q)).withColumn(out, entities_from_tokens("_etoks", limit)).drop("_etoks")


def candidate_entities(q: ColumnOrName, limit: int = 5) -> Column:
    """Q2 as one column expression (convenient on small inputs; on tables use
    ``with_candidate_entities``, which computes the tokens once per row)."""
    return entities_from_tokens(entity_tokens(q), limit)


def _rfind(text: Column, needle: str) -> Column:
    pos = F.instr(F.reverse(text), needle[::-1])
    return F.when(pos > 0, F.char_length(text) - pos - F.lit(len(needle) - 1)).otherwise(F.lit(-1))


def _clean_stages(cands: Column) -> Column:
    """Q5 cleaning of every candidate as a chain of array transforms, so each
    intermediate value is computed once per element."""
    s1 = F.transform(cands, lambda c: py_strip(F.regexp_replace(
        py_strip(F.regexp_replace(py_strip(c.cast("string")), r"(?i)^Q\.\s*", "")), rf"(?U)^(And|and){SPACE}+", "")))
    s2 = F.transform(s1, lambda t: F.struct(t.alias("t"), F.greatest(_rfind(t, ". "), _rfind(t, "? ")).alias("lb")))
    s3 = F.transform(s2, lambda x: F.struct(
        x["t"].alias("t"), x["lb"].alias("lb"),
        F.regexp_instr(F.substring(x["t"], x["lb"] + 2, F.lit(1 << 30)), F.lit(STARTER_RE)).alias("tail_pos"),
        F.regexp_instr(x["t"], F.lit(STARTER_RE)).alias("first_pos")))
    s4 = F.transform(s3, lambda x: F.when(x["tail_pos"] > 0, py_strip(F.substring(x["t"], x["lb"] + x["tail_pos"] + 1, F.lit(1 << 30))))
                     .when(x["first_pos"] > 0, py_strip(F.substring(x["t"], x["first_pos"], F.lit(1 << 30))))
                     .otherwise(x["t"]))
    s5 = F.transform(s4, lambda c: F.when(F.substring(c, 1, 1).rlike(r"^\p{Ll}"),
                                          F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))).otherwise(c))
    return F.filter(s5, lambda c: F.size(words(c)) >= 3)


def clean_sub_questions(candidates: ColumnOrName, original: ColumnOrName, limit: int = 3) -> Column:
    """Q5: per candidate strip, drop ``Q.`` and a leading ``And``, cut to the
    first interrogative starter after the last sentence break (else the first
    starter), capitalise, drop under 3 words; distinct in order, first
    ``limit``; none left -> the original question."""
    kept = F.slice(F.array_distinct(_clean_stages(_c(candidates))), 1, limit)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(_c(original).cast("string")))


def split_candidates(q: ColumnOrName) -> Column:
    """Q6 first step: struct(kind, cands) with kind 'q' (two or more ``?``),
    'and' (connector split gave pieces) or 'none'."""
    text = F.array_join(words(F.coalesce(_c(q).cast("string"), F.lit("None"))), " ")
    n_q = F.char_length(text) - F.char_length(F.replace(text, F.lit("?"), F.lit("")))
    by_and = F.split(text, CONNECTOR_RE)
    return (F.when(n_q >= 2, F.struct(F.lit("q").alias("kind"), F.regexp_extract_all(text, F.lit(r"[^?]+\?"), 0).alias("cands")))
            .when(F.size(by_and) > 1, F.struct(F.lit("and").alias("kind"), by_and.alias("cands")))
            .otherwise(F.struct(F.lit("none").alias("kind"), F.array().cast("array<string>").alias("cands"))))


def rule_split(q: ColumnOrName) -> Column:
    """Q6: two or more ``?`` -> the pieces ending in ``?``; else split before
    ``and`` + starter; cleaned by Q5; else the question unchanged."""
    orig = _c(q).cast("string")
    sc = split_candidates(orig)
    return F.when(sc["kind"] == "none", F.array(orig)).otherwise(clean_sub_questions(sc["cands"], orig))


def reply_sub_questions(raw: ColumnOrName) -> Column:
    """``sub_questions`` of a model JSON reply (fences removed; whole text first,
    then the outermost object): null when the key is absent or the reply is not
    JSON; an empty array when the key is there without an array of questions."""
    clean = py_strip(F.replace(F.replace(_c(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    whole = F.try_parse_json(clean)
    inner = F.try_parse_json(F.regexp_extract(clean, r"(?s)\{.*\}", 0))
    v = F.coalesce(whole, inner)
    there = F.try_variant_get(v, "$.sub_questions", "variant")
    asked = F.try_variant_get(v, "$.sub_questions", "array<string>")
    return F.when(there.isNotNull(), F.coalesce(asked, F.array().cast("array<string>")))


def with_route_split(df, q: str, raw: str, out: str = "split"):
    """Q7 on a DataFrame, staged in projections so that the rule split and the
    reply parse are each computed once per row. Adds struct column ``out``."""
    staged = (df.withColumn("_rule", rule_split(q))
              .withColumn("_subs", reply_sub_questions(raw))
              .withColumn("_wc", word_count(q)))
    orig = F.col(q).cast("string")
    mk = lambda arr, r, s: F.struct(arr.alias("sub_questions"), r.alias("raw_splitter_output"),
                                    F.lit(s).alias("splitter_source"))
    route = (F.when(F.size("_rule") > 1, mk(F.col("_rule"), F.lit(RULE_SPLIT_MARK), "rule_based"))
             .when(F.col("_wc") < 8, mk(F.array(orig), F.lit(SHORT_SPLIT_MARK), "short_question"))
             .when(F.col("_subs").isNotNull(), mk(clean_sub_questions("_subs", orig), F.col(raw), "llm_base"))
             .otherwise(mk(F.array(orig), F.col(raw), "parser_fallback")))
    return staged.withColumn(out, route).drop("_rule", "_subs", "_wc")
