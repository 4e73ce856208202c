"""Queries for text rules: P3-P9, O1-O7, Q1-Q10.

The oracle side writes each rule again in DuckDB SQL (RE2 has no look-around
and ASCII word boundaries, so boundaries are spelled out with Unicode
classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions import questions as QF
from answerlab.functions import replies as RF
from answerlab.functions import text as T
from answerlab.functions.constants import (COARSE_LABELS, CONTEXT_HEADER, FINE_LABELS, QUESTION_TYPE_DEFAULT,
                                           QUESTION_TYPES, REPLY_SHORTCUTS, STARTER_WORDS)
from answerlab.operators import label_match as LM
from answerlab.operators import measures as M
from answerlab.operators import questions as Q
from answerlab.operators import stats as S
from answerlab.plans.oracle_views import PYSPACE, with_views
from answerlab.plans.registry import query
from answerlab.sources import views
from answerlab.sources.tables import table

# ---------------------------------------------------------------- SQL helpers


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{PYSPACE}+|{PYSPACE}+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{PYSPACE}+'), lambda w: w <> '')"


def chain_sql(cases: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + f" else {default} end"


def match_sql(raw_l: str, labels, both: bool) -> str:
    cases = [(f"{raw_l} = {sq(lbl.lower())}", sq(lbl)) for lbl in labels]
    cases += [(f"contains({raw_l}, {sq(k)})", sq(v)) for k, v in REPLY_SHORTCUTS if v in labels]
    for lbl in labels:
        c = f"contains({raw_l}, {sq(lbl.lower())})"
        if both:
            c = f"({c} or contains({sq(lbl.lower())}, {raw_l}))"
        cases.append((c, sq(lbl)))
    return chain_sql(cases, "'PARSE_ERROR'")


def o1_sql(x, labels):
    return match_sql(f"lower({strip_sql(x)})", labels, True)


def o2_sql(x, labels):
    return match_sql(f"lower({strip_sql(x)})", labels, False)


def o3_sql(x, labels):
    tag = o2_sql(rf"regexp_extract({x}, '(?is)<label>\s*(.*?)\s*</label>', 1)", labels)
    last = o2_sql(f"string_split({strip_sql(x)}, chr(10))[-1]", labels)
    anyw = chain_sql([(f"contains(lower({x}), {sq(lbl.lower())})", sq(lbl)) for lbl in labels], "'PARSE_ERROR'")
    return f"case when {tag} <> 'PARSE_ERROR' then {tag} when {last} <> 'PARSE_ERROR' then {last} else {anyw} end"


def o5_sql(x, labels):
    t = strip_sql(x)
    c = rf"regexp_extract({t}, '(?s)\{{.*\}}', 0)"
    # the first key that is there, whatever its value; json null is None as text
    def key(k):
        return f"""case json_type({c}::json, '$.{k}') when 'NULL' then 'None' when 'BOOLEAN' then
            case json_extract_string({c}::json, '$.{k}') when 'true' then 'True' else 'False' end
            else json_extract_string({c}::json, '$.{k}') end"""
    kv = " , ".join(key(k) for k in ("category", "categoria", "label"))
    contained = chain_sql([(f"contains(lower({t}), {sq(lbl.lower())})", sq(lbl)) for lbl in labels], "null")
    return (f"case when json_valid({c}) and json_type({c}::json) = 'OBJECT' and coalesce({kv}) is not null "
            f"then {strip_sql(f'coalesce({kv})')} else {contained} end")


NONWORD = r"[^\p{L}\p{N}_]"
STARTERS = "|".join(STARTER_WORDS)


def first_starter_sql(s: str) -> str:
    """0-based position of the first starter word (Unicode word boundaries), or -1."""
    pat = rf"(?is)^(.*?(?:^|{NONWORD}))(?:{STARTERS})(?:{NONWORD}|$)"
    return f"case when regexp_matches({s}, '{pat}') then length(regexp_extract({s}, '{pat}', 1)) else -1 end"


def rfind_sql(t: str, needle: str) -> str:
    rev = needle[::-1]
    return (f"case when instr(reverse({t}), '{rev}') > 0 then length({t}) - instr(reverse({t}), '{rev}') - "
            f"{len(needle) - 1} else -1 end")


def clean_list_sql(cands: str, original: str) -> str:
    """Q5 on a list expression, in DuckDB."""
    s1 = f"list_transform({cands}, lambda c: {strip_sql(strip_sql(rf'''regexp_replace({strip_sql('c')}, '(?i)^Q\.\s*', '')'''))})"
    s2 = f"list_transform({s1}, lambda c: {strip_sql(rf'''regexp_replace(c, '^(And|and)\s+', '')''')})"
    lb = f"greatest({rfind_sql('t', '. ')}, {rfind_sql('t', '? ')})"
    s3 = f"list_transform({s2}, lambda t: struct_pack(t := t, lb := {lb}))"
    tail = "substr(x.t, x.lb + 2)"
    s4 = (f"list_transform({s3}, lambda x: case when {first_starter_sql(tail)} >= 0 "
          f"then {strip_sql(f'substr(x.t, x.lb + 2 + {first_starter_sql(tail)})')} "
          f"when {first_starter_sql('x.t')} >= 0 then {strip_sql(f'substr(x.t, 1 + {first_starter_sql('x.t')})')} "
          f"else x.t end)")
    s5 = (f"list_transform({s4}, lambda c: case when regexp_matches(substr(c, 1, 1), '^\\p{{Ll}}') "
          f"then upper(substr(c, 1, 1)) || substr(c, 2) else c end)")
    s6 = f"list_filter({s5}, lambda c: length({words_sql('c')}) >= 3)"
    s7 = f"list_slice(list_filter({s6}, lambda c, i: list_position({s6}, c) = i), 1, 3)"
    return f"case when length({s7}) > 0 then {s7} else [{original}] end"


def rule_split_sql(q: str) -> str:
    text = f"array_to_string({words_sql(f'coalesce({q}, {sq("None")})')}, ' ')"
    byq = rf"regexp_extract_all({text}, '[^?]+\?')"
    marked = (rf"regexp_replace({text}, '\s+((?:And|and)\s+(?:{STARTERS})(?:{NONWORD}|$))', "
              rf"chr(1) || '\1', 'g')")
    byand = f"string_split({marked}, chr(1))"
    nq = f"(length({text}) - length(replace({text}, '?', '')))"
    return (f"case when {nq} >= 2 then {clean_list_sql(byq, q)} "
            f"when length({byand}) > 1 then {clean_list_sql(byand, q)} else [{q}] end")


# ---------------------------------------------------------------- P3-P9

WC_SQL = "length(" + words_sql("coalesce(text, '')") + ")"


@query("p3_word_count", f"select doc_id, {WC_SQL}::integer as word_count from documents")
def q_p3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("word_count"))


@query("p4_char_length", "select doc_id, length(text)::integer as n_chars, length(text) <= 300 as fits_300 from documents")
def q_p4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.char_length("text").alias("n_chars"),
                                                T.fits_within("text", 300).alias("fits_300"))


@query("p5_truncate_words", f"""
select doc_id, case when text is null or text = '' then 'Unknown'
  else array_to_string(list_slice({words_sql('text')}, 1, 200), ' ') end as text_200
from documents""")
def q_p5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_words("text", 200).alias("text_200"))


@query("p6_truncate_chars", """
select doc_id, case when length(text) > 150 then substr(text, 1, 150) else text end as snippet,
  case when length(text) > 1500 then substr(text, 1, 1500) || '...' else text end as cut
from documents""")
def q_p6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.truncate_chars("text", 150, ellipsis=False).alias("snippet"),
        T.truncate_chars("text", 1500).alias("cut"))


@query("p7_pair_text", with_views("""
select conv_id, turn, 'QUESTION: ' || question || ' ANSWER: ' ||
  case when length(answer) > 1500 then substr(answer, 1, 1500) else answer end as corpus_text
from v_qa""", "v_qa"))
def q_p7(spark, sf):
    return views.qa(spark, sf).select("conv_id", "turn", T.pair_text("question", "answer", 1500).alias("corpus_text"))


@query("p8_feature_prefix", with_views(f"""
with w as (select doc_id, text, lang, split, {WC_SQL} as wc from v_split
           left join (select doc_id, lang from documents) d using (doc_id)),
p as (select quantile_cont(wc, 0.3333) as p33, quantile_cont(wc, 0.6667) as p67 from w where split = 'train'),
c as (select doc_id, text, case when doc_id % 4 = 0 then null else lang end as tone,
        case when split <> 'train' then null when wc <= p33 then 'Short' when wc <= p67 then 'Medium' else 'Large' end as lc
      from w, p)
select doc_id, case when concat_ws(' | ', case when tone is not null and tone <> '' then 'Tone: ' || tone end,
                                          case when lc is not null and lc <> '' then 'Length: ' || lc end) <> ''
  then concat_ws(' | ', case when tone is not null and tone <> '' then 'Tone: ' || tone end,
                        case when lc is not null and lc <> '' then 'Length: ' || lc end) || ' | Answer: ' || coalesce(text, 'None')
  else coalesce(text, 'None') end as model_input
from c""", "v_split"))
def q_p8(spark, sf):
    df = S.length_category(views.split(spark, sf), "text", F.col("split") == "train")
    df = df.withColumn("tone", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("label")))
    return df.select("doc_id", T.feature_prefix("text", "tone", "length_category").alias("model_input"))


@query("p9_tone_tag", "select doc_id, '[TONE OF RESPONSE: ' || lang || ']' || chr(10) || text as tagged from documents")
def q_p9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tone_tag("text", "lang").alias("tagged"))


# ---------------------------------------------------------------- O1-O7

@query("o1_normalise_label", with_views(f"""
select doc_id, {o1_sql('raw', FINE_LABELS)} as fine, {o1_sql('raw', COARSE_LABELS)} as coarse from v_replies""",
                                        "v_replies"))
def q_o1(spark, sf):
    r = RF.with_reply_label(views.replies(spark, sf), "raw", FINE_LABELS, "label", "fine")
    return RF.with_reply_label(r, "raw", COARSE_LABELS, "label", "coarse").select("doc_id", "fine", "coarse")


@query("o2_normalise_strict", with_views(f"""
select doc_id, {o2_sql('raw', FINE_LABELS)} as fine, {o2_sql('raw', COARSE_LABELS)} as coarse from v_replies""",
                                         "v_replies"))
def q_o2(spark, sf):
    r = RF.with_reply_label(views.replies(spark, sf), "raw", FINE_LABELS, "strict", "fine")
    return RF.with_reply_label(r, "raw", COARSE_LABELS, "strict", "coarse").select("doc_id", "fine", "coarse")


@query("o3_normalise_tagged", with_views(f"""
select doc_id, {o3_sql('raw', FINE_LABELS)} as fine, {o3_sql('raw', COARSE_LABELS)} as coarse from v_replies""",
                                         "v_replies"))
def q_o3(spark, sf):
    r = RF.with_reply_label(views.replies(spark, sf), "raw", FINE_LABELS, "tagged", "fine")
    return RF.with_reply_label(r, "raw", COARSE_LABELS, "tagged", "coarse").select("doc_id", "fine", "coarse")


def _label_tables(spark):
    return (views.taxonomy(spark).select("label", F.col("pos").alias("rank")),
            views.coarse_labels(spark).select("label", F.col("pos").alias("rank")))


@query("o1_normalise_by_table", with_views(f"""
select doc_id, {o1_sql('raw', FINE_LABELS)} as fine, {o1_sql('raw', COARSE_LABELS)} as coarse from v_replies""", "v_replies"))
def q_o1_table(spark, sf):
    fine, coarse = _label_tables(spark)
    r = LM.with_table_label(views.replies(spark, sf), "raw", fine, "label", "fine")
    return LM.with_table_label(r, "raw", coarse, "label", "coarse").select("doc_id", "fine", "coarse")


@query("o3_normalise_by_table", with_views(f"""
select doc_id, {o3_sql('raw', FINE_LABELS)} as fine, {o3_sql('raw', COARSE_LABELS)} as coarse from v_replies""", "v_replies"))
def q_o3_table(spark, sf):
    fine, coarse = _label_tables(spark)
    r = LM.with_table_label(views.replies(spark, sf), "raw", fine, "tagged", "fine")
    return LM.with_table_label(r, "raw", coarse, "tagged", "coarse").select("doc_id", "fine", "coarse")


@query("o4_reasoning_steps", with_views(rf"""
select doc_id, array_to_string(list_transform(regexp_extract_all(raw, '(?s)<step\d>(.*?)</step\d>', 1),
  lambda s: {strip_sql('s')}), ' | ') as reasoning from v_replies""", "v_replies"))
def q_o4(spark, sf):
    return views.replies(spark, sf).select("doc_id", RF.reasoning_steps("raw").alias("reasoning"))


@query("o5_category_from_json", with_views(f"""
select doc_id, {o5_sql('raw', RF.CHAIN_LABEL_ORDER)} as category from v_replies""", "v_replies"))
def q_o5(spark, sf):
    return views.replies(spark, sf).select("doc_id", RF.category_from_json("raw").alias("category"))


def _o6_sql():
    lbls = ", ".join(sq(x) for x in RF.CHAIN_LABEL_ORDER)
    first, second = o5_sql("a.raw", RF.CHAIN_LABEL_ORDER), o5_sql("b.raw", RF.CHAIN_LABEL_ORDER)
    # typed out, not imported: the order in which the reference walks its labels
    order = ["Explicit", "Declining to answer", "Claims ignorance", "Clarification", "Dodging", "Deflection", "General", "Implicit",
             "Partial/half-answer"]
    contained = chain_sql([(f"contains(lower(a.raw), {sq(lbl.lower())})", sq(lbl)) for lbl in order], "'Dodging'")
    return with_views(f"""
select a.doc_id, {contained} as contained,
  case when {first} in ({lbls}) then {first} when {second} in ({lbls}) then {second} else 'Dodging' end as evaluated
from v_replies a left join v_replies b on b.doc_id = a.doc_id + 1""", "v_replies")


@query("o6_contained_label", _o6_sql())
def q_o6(spark, sf):
    a = views.replies(spark, sf)
    b = views.replies(spark, sf).select((F.col("doc_id") - 1).alias("doc_id"), F.col("raw").alias("retry"))
    return a.join(b, "doc_id", "left").select(
        "doc_id", RF.contained_label("raw").alias("contained"),
        RF.evaluated_label("raw", "retry").alias("evaluated"))


@query("o7_parse_error_rate", with_views(f"""
select count(*) as n_total, count(*) filter (where p = 'PARSE_ERROR') as n_parse_errors,
  count(*) filter (where p <> 'PARSE_ERROR') as n_valid, round(avg(case when p = 'PARSE_ERROR' then 1.0 else 0.0 end), 6) as parse_error_share
from (select {o3_sql('raw', COARSE_LABELS)} as p from v_replies) x""", "v_replies"), "R")
def q_o7(spark, sf):
    r = RF.with_reply_label(views.replies(spark, sf), "raw", COARSE_LABELS, "tagged", "pred_label")
    return M.parse_error_rate(r).select("n_total", "n_parse_errors", "n_valid",
                                        F.round("parse_error_share", 6).alias("parse_error_share"))


# ---------------------------------------------------------------- Q1-Q10

def _qtype_sql(q: str) -> str:
    n = rf"regexp_replace(lower({strip_sql(q)}), '{PYSPACE}+', ' ', 'g')"
    cases = [(f"regexp_matches({n}, {sq(p)})", f"{{'question_type': {sq(t)}, 'expected_length': {sq(ln)}, 'hint': {sq(h)}}}")
             for t, p, ln, h in QUESTION_TYPES]
    t, ln, h = QUESTION_TYPE_DEFAULT
    return chain_sql(cases, f"{{'question_type': {sq(t)}, 'expected_length': {sq(ln)}, 'hint': {sq(h)}}}")


@query("q1_question_type", with_views(f"""
select conv_id, turn, qt.question_type, qt.expected_length, qt.hint
from (select conv_id, turn, {_qtype_sql('question')} as qt from v_questions) x""", "v_questions"))
def q_q1(spark, sf):
    qt = QF.question_type("question")
    return views.questions(spark, sf).select("conv_id", "turn", qt["question_type"].alias("question_type"),
                                             qt["expected_length"].alias("expected_length"), qt["hint"].alias("hint"))


def _entities_sql(q: str) -> str:
    toks = f"list_transform({words_sql(strip_sql(q))}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"
    up = "(regexp_matches({x}, '^\\p{{Lu}}'))"
    cand = (f"list_filter(list_transform(tk, lambda w, i: case when i >= 2 and {up.format(x='w')} and length(w) > 1 then "
            f"case when coalesce({up.format(x='tk[i+1]')}, false) and coalesce({up.format(x='tk[i+2]')}, false) "
            f"then w || ' ' || tk[i+1] || ' ' || tk[i+2] "
            f"when coalesce({up.format(x='tk[i+1]')}, false) then w || ' ' || tk[i+1] else w end end), lambda e: e is not null)")
    return (f"(select case when length(tk) <= 1 then [] else "
            f"list_slice(list_filter(c, lambda e, i: list_position(c, e) = i), 1, 5) end "
            f"from (select tk, {cand} as c from (select {toks} as tk)))")


@query("q2_candidate_entities", with_views(f"""
select conv_id, turn, array_to_string({_entities_sql('question')}, '; ') as entities from v_qa""", "v_qa"))
def q_q2(spark, sf):
    qa = QF.with_candidate_entities(views.qa(spark, sf), "question")
    return qa.select("conv_id", "turn", F.array_join("entities", "; ").alias("entities"))


_CTX_SQL = f"""
e as (select conv_id, turn, unnest(ents) as entity, generate_subscripts(ents, 1) as pos
      from (select conv_id, turn, {_entities_sql('question')} as ents from v_qa) x),
s as (select e.conv_id, e.turn, e.pos, '[' || e.entity || ']: ' ||
        case when ends_with(sm, '.') then sm else sm || '.' end as snippet
      from e join (select title, {strip_sql("array_to_string(list_slice(string_split(article, '. '), 1, 3), '. ')")} as sm
                   from v_articles) a on a.title = e.entity),
r as (select *, coalesce(sum(length(snippet)) over (partition by conv_id, turn order by pos
        rows between unbounded preceding and 1 preceding), 0) as before from s),
c as (select conv_id, turn, {sq(CONTEXT_HEADER)} || chr(10) || string_agg(snippet, chr(10) order by pos) as rag_context
      from r where before < 600 group by conv_id, turn)"""


@query("q3_attach_context", with_views(f"""
with {_CTX_SQL.strip()}
select q.conv_id, q.turn, coalesce(c.rag_context, '') as rag_context
from v_qa q left join c using (conv_id, turn)""", "v_qa", "v_articles"))
def q_q3(spark, sf):
    qa = views.qa(spark, sf)
    return Q.attach_context(qa, views.articles(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "rag_context")


@query("q4_question_context_message", with_views(f"""
with {_CTX_SQL.strip()}
select q.conv_id, q.turn, concat_ws(chr(10), case when coalesce(c.rag_context, '') <> '' then c.rag_context || chr(10) end,
  'QUESTION TYPE: ' || upper(qt.question_type), 'RESPONSE EXPECTATION: ' || qt.hint, '',
  'QUESTION: ' || q.question, chr(10) || 'ANSWER: ' || q.answer) as user_message
from (select *, {_qtype_sql('question')} as qt from v_qa) q left join c using (conv_id, turn)""", "v_qa", "v_articles"))
def q_q4(spark, sf):
    qa = views.qa(spark, sf)
    ctx = Q.attach_context(qa, views.articles(spark, sf), ["conv_id", "turn"])
    return Q.question_context_message(ctx).select("conv_id", "turn", "user_message")


Q5_CANDS = r"regexp_extract_all(question, '[^?]+\?')"


@query("q5_clean_sub_questions", with_views(f"""
select conv_id, turn, array_to_string({clean_list_sql(Q5_CANDS, 'question')}, ' || ') as sub_questions
from v_questions""", "v_questions"))
def q_q5(spark, sf):
    qs = views.questions(spark, sf)
    c = QF.clean_sub_questions(F.regexp_extract_all("question", F.lit(r"[^?]+\?"), 0), "question")
    return qs.select("conv_id", "turn", F.array_join(c, " || ").alias("sub_questions"))


@query("q6_rule_split", with_views(f"""
select conv_id, turn, array_to_string(r, ' || ') as sub_questions, length(r)::integer as n_parts
from (select conv_id, turn, {rule_split_sql('question')} as r from v_questions) x""", "v_questions"))
def q_q6(spark, sf):
    r = QF.rule_split("question")
    return views.questions(spark, sf).select("conv_id", "turn", F.array_join(r, " || ").alias("sub_questions"),
                                             F.size(r).alias("n_parts"))


def _splitter_reply_sql() -> str:
    return """case (conv_id + turn) % 5
      when 0 then '```json' || chr(10) || '{"sub_questions": ["What is item ' || conv_id || ' about?", "And how does turn ' || turn || ' end?"]}' || chr(10) || '```'
      when 1 then 'Sure: {"sub_questions": ["Why was it done?", "q"]} ok'
      when 2 then case when conv_id % 2 = 0 then '{"other": 1}' else '{"sub_questions": null}' end
      when 3 then 'no json here'
      else '{"sub_questions": ["short", "Is this a real question here?"]}' end"""


def _splitter_reply():
    k = (F.col("conv_id") + F.col("turn")) % 5
    return (F.when(k == 0, F.concat(F.lit('```json\n{"sub_questions": ["What is item '), F.col("conv_id").cast("string"),
                                     F.lit(' about?", "And how does turn '), F.col("turn").cast("string"),
                                     F.lit(' end?"]}\n```')))
            .when(k == 1, F.lit('Sure: {"sub_questions": ["Why was it done?", "q"]} ok'))
            .when((k == 2) & (F.col("conv_id") % 2 == 0), F.lit('{"other": 1}'))
            .when(k == 2, F.lit('{"sub_questions": null}'))
            .when(k == 3, F.lit("no json here"))
            .otherwise(F.lit('{"sub_questions": ["short", "Is this a real question here?"]}')))


def _reply_subs_sql(raw: str) -> str:
    clean = strip_sql(f"replace(replace({raw}, '```json', ''), '```', '')")
    inner = rf"regexp_extract({clean}, '(?s)\{{.*\}}', 0)"
    v = f"case when json_valid({clean}) then {clean} when json_valid({inner}) then {inner} end"
    return (f"case when json_type(({v})::json, '$.sub_questions') = 'ARRAY' then cast(json_extract_string(({v})::json, '$.sub_questions[*]') as varchar[]) "
            f"when json_type(({v})::json, '$.sub_questions') is not null then []::varchar[] end")


@query("q7_route_split", with_views(f"""
select conv_id, turn, array_to_string(subs, ' || ') as sub_questions, raw_out as raw_splitter_output, src as splitter_source
from (select conv_id, turn,
  case when length(rs) > 1 then rs when {WC_SQL.replace('text', 'question')} < 8 then [question]
       when ls is not null then {clean_list_sql('ls', 'question')} else [question] end as subs,
  case when length(rs) > 1 then '__RULE_BASED_SPLIT__' when {WC_SQL.replace('text', 'question')} < 8 then '__SKIPPED_SHORT_QUESTION__'
       else raw end as raw_out,
  case when length(rs) > 1 then 'rule_based' when {WC_SQL.replace('text', 'question')} < 8 then 'short_question'
       when ls is not null then 'llm_base' else 'parser_fallback' end as src
  from (select conv_id, turn, question, raw, {rule_split_sql('question')} as rs, {_reply_subs_sql('raw')} as ls
        from (select *, {_splitter_reply_sql()} as raw from v_questions) a) b) c""", "v_questions"))
def q_q7(spark, sf):
    qs = QF.with_route_split(views.questions(spark, sf).withColumn("raw", _splitter_reply()), "question", "raw")
    r = F.col("split")
    return qs.select("conv_id", "turn", F.array_join(r["sub_questions"], " || ").alias("sub_questions"),
                     r["raw_splitter_output"].alias("raw_splitter_output"), r["splitter_source"].alias("splitter_source"))


_Q8_SQL = """
pl as (select doc_id, label, count(*) as n_l, min(part) as first_part from v_sub_answers group by doc_id, label),
ag as (select doc_id, sum(n_l) as n, sum(case when label = 'Explicit' then n_l else 0 end) as ne,
         sum(case when label = 'Declining to answer' then n_l else 0 end) as nd,
         sum(case when label = 'Claims ignorance' then n_l else 0 end) as ni,
         arg_max(label, n_l * 1000000 - first_part) as mc from pl group by doc_id),
fin as (select doc_id, n, case when n = 1 then mc when ne = n then 'Explicit' when n >= 3 and ne / n >= 0.67 then 'Explicit'
          when nd + ni = n then case when nd >= ni then 'Declining to answer' else 'Claims ignorance' end
          when ne > 0 then 'Partial/half-answer' else mc end as f0 from ag),
f as (select doc_id, n, case when f0 in (select label from v_taxonomy) then f0 else 'Dodging' end as final_label from fin)"""


@query("q8_aggregate_sub_answers", with_views(f"""
with {_Q8_SQL.strip()}
select doc_id, n::bigint as n, final_label from f""", "v_sub_answers"))
def q_q8(spark, sf):
    return Q.aggregate_sub_answers(views.sub_answers(spark, sf), ["doc_id"])


@query("q9_hybrid_label", with_views(f"""
with {_Q8_SQL.strip()},
d as (select distinct doc_id, direct_label from v_sub_answers),
h as (select f.doc_id, case when tf.coarse = 'Ambivalent' and td.coarse in ('Clear Reply', 'Clear Non-Reply')
        then d.direct_label else f.final_label end as label from f join d using (doc_id)
      left join v_taxonomy tf on tf.label = f.final_label left join v_taxonomy td on td.label = d.direct_label)
select h.doc_id, h.label as final_label, t.coarse as coarse_final from h left join v_taxonomy t on t.label = h.label""",
                                     "v_sub_answers"))
def q_q9(spark, sf):
    parts = views.sub_answers(spark, sf)
    agg = Q.aggregate_sub_answers(parts, ["doc_id"])
    direct = parts.groupBy("doc_id").agg(F.any_value("direct_label").alias("direct_label"))
    lbl, macro = Q.hybrid_label("final_label", "direct_label")
    return agg.join(direct, "doc_id").select("doc_id", lbl.alias("final_label"), macro.alias("coarse_final"))


@query("q10_split_log", with_views(f"""
with {_Q8_SQL.strip()},
l as (select doc_id, to_json(list(label order by part))::varchar as labels,
        to_json(list('Part ' || part || ' of ' || doc_id || '?' order by part))::varchar as sub_questions,
        to_json(list('[' || label || ']' order by part))::varchar as raw_outputs, any_value(direct_label) as direct_label,
        case when count(*) > 1 then 'rule_based' else 'short_question' end as splitter_source
      from v_sub_answers group by doc_id)
select l.*, f.final_label from l join f using (doc_id)""", "v_sub_answers"))
def q_q10(spark, sf):
    parts = views.sub_answers(spark, sf).select(
        "*", F.concat(F.lit("Part "), F.col("part"), F.lit(" of "), F.col("doc_id"), F.lit("?")).alias("sub_question"),
        F.concat(F.lit("["), F.col("label"), F.lit("]")).alias("raw"),
        F.when(F.col("doc_id") % 3 > 0, "rule_based").otherwise("short_question").alias("splitter_source"))
    return Q.split_log(parts, ["doc_id"], extra=["direct_label", "splitter_source"],
                       lists={"sub_questions": "sub_question", "raw_outputs": "raw"}, final="final_label")
