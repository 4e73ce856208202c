"""DuckDB text of the fixture views, used only by the oracle queries.

``with_views(sql, "v_a", "v_b")`` prefixes a query with the CTEs it needs
(dependencies included, in order).
"""

from __future__ import annotations

_TAX_ROWS = ("(0,'Explicit','Clear Reply'),(1,'Implicit','Ambivalent'),(2,'General','Ambivalent'),"
             "(3,'Partial/half-answer','Ambivalent'),(4,'Dodging','Ambivalent'),(5,'Deflection','Ambivalent'),"
             "(6,'Declining to answer','Clear Non-Reply'),(7,'Claims ignorance','Clear Non-Reply'),"
             "(8,'Clarification','Clear Non-Reply')")

#: One white-space character as Python's str.split sees it, typed out for RE2 (which has ASCII classes only).
PYSPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_taxonomy": ([], f"select * from (values {_TAX_ROWS}) as t(pos, label, coarse)"),
    "v_coarse": ([], "select * from (values (0,'Clear Reply'),(1,'Ambivalent'),(2,'Clear Non-Reply')) as t(pos, label)"),
    "v_votes": (["v_taxonomy"], """
        select p.doc_id, a.label as annotator1, case when p.p2 = -1 then '' else b.label end as annotator2,
               c.label as annotator3, o.coarse as official_label
        from (select doc_id, doc_id % 9 as p1,
                case when doc_id % 4 = 1 then (doc_id + 1) % 9 when doc_id % 11 = 3 then -1 else doc_id % 9 end as p2,
                case when doc_id % 4 = 1 then (doc_id + 2) % 9 when doc_id % 4 = 2 then (doc_id + 4) % 9
                     when doc_id % 7 = 5 then null else doc_id % 9 end as p3,
                (doc_id + doc_id % 3) % 9 as pc from documents) p
        join v_taxonomy a on a.pos = p.p1 left join v_taxonomy b on b.pos = p.p2
        left join v_taxonomy c on c.pos = p.p3 join v_taxonomy o on o.pos = p.pc"""),
    "v_predictions": ([], """
        select doc_id, lang as true_label,
          case when doc_id % 37 = 0 then 'PARSE_ERROR'
               when doc_id % 5 = 0 then case lang when 'en' then 'fr' when 'fr' then 'de' when 'de' then 'es' else 'en' end
               else lang end as pred_label
        from documents"""),
    "v_qa": ([], """
        select conv_id, turn, question, answer from (
          select conv_id, turn, role, text as question,
            lead(role) over (partition by conv_id order by turn) as next_role,
            lead(text) over (partition by conv_id order by turn) as answer from conversations) x
        where role = 'user' and next_role = 'assistant'"""),
    "v_questions": (["v_qa"], """
        select conv_id, turn, case (conv_id + turn) % 12
          when 0 then concat('Will you ', s, '?') when 1 then concat('What is ', s, '?')
          when 2 then concat('Why ', s, '? And how do you ', s, '?') when 3 then concat('When ', s, '?')
          when 4 then concat('Who ', s, ' and do you ', s, '?') when 5 then concat('How many ', s, '?')
          when 6 then concat('How do you feel ', s, '?') when 7 then concat('what caused ', s, '?')
          when 8 then 'So?' when 9 then concat('Q. And is ', s, '? Yes? Can ', s, '?')
          when 10 then concat('  What   date ', s, '?') else s end as question, answer
        from (select conv_id, turn, question as s, answer from v_qa) x"""),
    "v_replies": ([], """
        select doc_id, case doc_id % 12 when 0 then 'Explicit' when 1 then ' clear non reply ' when 2 then concat('I think: Dodging, not General. ', coalesce(text, ''))
          when 3 then '' when 4 then concat('<step1>', coalesce(text, ''), '</step1><step2>', chr(160), 'b', chr(8195), '</step2><label>', chr(160), 'General </label>')
          when 5 then concat('<label>none</label>', chr(10), coalesce(text, ''), chr(10), chr(12288), 'Deflection') when 6 then '{"category": "Claims ignorance"}'
          when 7 then 'x {"label": "Implicit"} y' when 8 then case when doc_id % 24 = 8 then '{"category": null, "label": "Implicit"}' else '{"category": broken Clarification}' end when 9 then 'half-answer'
          when 10 then 'non-reply' else coalesce(text, '') end as raw
        from documents"""),
    "v_split": ([], """
        select doc_id, text, lang as label, source,
          case when ('0x' || substr(md5(cast(doc_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0 < 0.2
               then 'validation' else 'train' end as split
        from documents"""),
    "v_text_labels": ([], "select d.*, l.quality, l.toxic from documents d join labels l using (doc_id)"),
    "v_vectors_q": ([], "select * from embeddings where ('0x' || substr(md5(cast(vec_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0 < 0.2"),
    "v_vectors_c": ([], "select * from embeddings where ('0x' || substr(md5(cast(vec_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0 >= 0.2"),
    "v_logits": ([], """
        select doc_id, cast(case when doc_id % 13 = 0 then -100 else doc_id % 4 end as integer) as label_id,
          [((doc_id*1) % 17)/4.0, ((doc_id*2) % 17)/4.0, ((doc_id*3) % 17)/4.0, ((doc_id*4) % 17)/4.0]::double[] as logits
        from documents"""),
    "v_sub_answers": (["v_taxonomy"], """
        select s.doc_id, s.part, a.label as label, b.label as direct_label
        from (select doc_id, cast(unnest(range(0, doc_id % 3 + 1)) as integer) as part from documents) s
        join v_taxonomy a on a.pos = (s.doc_id * (s.part + 1)) % 9
        join v_taxonomy b on b.pos = (s.doc_id + 2) % 9"""),
    "v_clusters": ([], """
        select vec_id, embedding, cast(vec_id % 5 as integer) as cluster, cast(label % 3 as integer) as class
        from embeddings"""),
    "v_candidates": ([], """
        select doc_id, lang, attempt, (doc_id * 7 + attempt * 3) % 5 = 0 as accepted,
               substr(text, attempt + 1) as rewrite
        from (select doc_id, lang, text, cast(unnest(range(0, 4)) as integer) as attempt from documents) x"""),
    "v_pairs": ([], """
        select a.doc_id, a.text as original, b.text as rewrite
        from documents a join documents b on b.doc_id = a.doc_id + 1"""),
    "v_articles": ([], """
        select title, arg_min(text, doc_id) as article from (
          select regexp_replace(string_split_regex(trim(text), '\\s+')[1], '[^\\p{L}\\p{N}_\\s]', '', 'g') as title,
                 doc_id, text from documents) x
        where title <> '' group by title"""),
    "v_lexicon": ([], """select * from (values ('the','Assertive',1.0::double), ('than','Guarded',1.0::double),
        ('and','Dismissive',1.0::double), ('la','Guarded',0.5::double), ('in','Assertive',0.5::double)) t(word, tone, weight)"""),
    "v_balance": ([], """
        select e.vec_id as doc_id, e.embedding, case when e.label < 6 then 0 when e.label < 9 then 1 else 2 end as class,
          coalesce(d.text, '') as text,
          case when ('0x' || substr(md5(cast(e.vec_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0 < 0.2
               then 'validation' else 'train' end as split
        from embeddings e left join documents d on d.doc_id = e.vec_id"""),
    "v_done": ([], "select doc_id from documents where doc_id % 3 = 0"),
    "v_scored_events": ([], """
        select event_id, ts, event_type as true_label,
          case when event_id % 4 = 0 then case event_type when 'view' then 'click' when 'click' then 'purchase'
               when 'purchase' then 'signup' when 'signup' then 'error' when 'error' then 'view' end
               else event_type end as pred_label
        from events"""),
}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
