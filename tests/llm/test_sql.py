"""Registered SQL against the operators on awkward and planted tables (the
given tables hold no links between pages, few nulls, and no ties)."""

from __future__ import annotations

import duckdb
import pytest

from answerlab.llm.catalog import QUERIES
from tests.llm import brute as B


def _same(spark, folder, name, table):
    fn, sql = QUERIES[name]
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = fn(spark, str(folder))
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    assert rows == want
    return rows


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op6_minhash_near_dedup", "op7_line_dedup"])
def test_documents(spark, tmp_path, name):
    passage = " ".join(f"p{i}" for i in range(40))
    lines = "\n".join(f"line {i} says this" for i in range(8))
    near = [f"n{i}" for i in range(60)]
    texts = [passage, f"before {passage} after", f"{passage} {passage}", lines, f"{lines}\n\n{lines}\n", "same\n" * 5,
             f"end of\r\n{lines}", " ".join(near), " ".join(near[:-2] + ["other", "words"]), " ".join(near[5:]), "a b", "b a", "A  B"]
    docs = B.awkward(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = _same(spark, tmp_path, name, "documents")
    assert len(rows) == docs.count()


def test_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "#### a ### b \\ </turn> </turn"), (1, 1, "assistant", "😀 ok\n###\\"), (1, 1, "assistant", "😀 ok\n###\\"),
            (2, 0, "a: b", None), (2, None, None, "null turn"), (3, 0, "assistant", ""), (None, 0, "assistant", "no id"), (None, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(_same(spark, tmp_path, "op10_chat_formatting", "conversations")) == 5


def test_pages(spark, tmp_path):
    def link(href, rel="canonical"):
        return f'<html><LINK class="x" rel="{rel}" href="{href}"><p>'

    rows = [(1, "http://a.example.com/en/x", link("http://b.net/page")), (2, "http://b.net/page?utm_source=1", None),
            (3, "http://c.org/fr/y", "<meta http-equiv='refresh' content='30'><meta http-equiv=\"refresh\" content=\"0; URL='http://d.com/z'\">"),
            (4, "http://d.com/z/", ""), (5, "http://e.com/1", link("/2", "shortlink canonical")), (6, "http://e.com/2", link("http://x.net/")),
            (7, "http://f.com/a/b", link("c")), (8, "http://f.com/a/c#top", link("http://example.net/en/ok") + link("http://b.net/page")),
            (9, None, link("http://b.net/")), (10, "no scheme", link("http://b.net/")), (11, "", ""), (4, "http://d.com/z/", ""),
            (12, "https://WWW.Example.COM/de/1", link("http://g.com/?b=2&amp;a=1")), (13, "http://g.com?a=1&b=2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = _same(spark, tmp_path, "op2_redirect_equivalence", "pages")
    verdicts = {r[0]: r[4] for r in got}
    # 1 shares its target with 8, which also links to an allowed page: allow goes first
    assert [verdicts[i] for i in (1, 4, 5, 7, 8, 13)] == ["allow", "allow", "block", "allow", "allow", "block"]
