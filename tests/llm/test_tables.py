"""Sharding, URL filter, decontamination, packing, language ID, quality rules, chat formatting."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import brute as B
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from answerlab.llm import chat, decontamination, lang_id, packing, quality_rules, sharding, url_filters
from answerlab.llm.tokens import WordEncoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---- sharding

def test_shards_fit_and_lose_nothing(spark):
    rnd = random.Random(0)
    df = B.awkward(spark, ["x" * rnd.randint(0, 400) for _ in range(400)] + ["same"] * 90)
    # equal rows: same id too
    df = df.union(df.where("doc_id = 107").crossJoin(spark.range(50)).drop("id"))
    got = sharding.assign_shards(df, 1000)
    assert got.columns == df.columns + ["n_bytes", "depth", "bucket", "page"]
    rows = got.select("doc_id", "text", "n_bytes", "depth", "bucket", "page").collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in df.collect())
    shards = collections.defaultdict(list)
    for r in rows:
        assert len(r.bucket) == r.depth and r.n_bytes == len((r.text or "").encode()) + 32
        shards[r.bucket, r.page].append(r.n_bytes)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in shards.values())
    names = sorted({b for b, _ in shards})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # prefix-free directory
    by = collections.Counter()
    for r in rows:
        for d in range(r.depth):
            by[r.bucket[:d]] += r.n_bytes
    assert all(n > 1000 for n in by.values())  # only buckets above the limit split
    assert len({r.page for r in rows if r.doc_id == 107}) > 1  # overflow pages of equal rows


def test_sharding_empty_table_and_files(spark, tmp_path):
    assert sharding.assign_shards(B.awkward(spark, empty=True), 100).collect() == []
    df = B.awkward(spark, ["abc"] * 40)
    sharding.write_shards(df, str(tmp_path / "s"), 500)
    assert spark.read.parquet(str(tmp_path / "s")).count() == df.count()


# ---- URL filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _urls(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, rule string, component string")


def test_rules_and_propagation(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")

    def link(to):
        return f"<html><head><link href='{to}' rel=canonical></head>"
    pages = _urls(spark, [
        (1, "http://A.Example.NET/en/x?q", ""), (2, "https://foo.net/zz", None), (3, "http://foo.net", ""), (4, "nothing", ""), (5, None, None),
        (6, "http://notexample.com/de/", ""), (7, "http://example.com/de/a#b", ""), (8, "http://a.b.org/fr/x", ""),
        (9, "http://alias.io/1", link("http://bad.net/spam")),            # target blocked, not crawled
        (10, "http://alias.io/2", link("/1")),                              # relative, chain to 9
        (11, "http://mixed.io/a", link("http://bad.net/q")), (12, "http://mixed.io/b", link("http://mixed.io/a")),
        (13, "http://ok.org/fr/1", link("http://mixed.io/b")),              # an allowed member frees the unruled ones
        (14, "http://r.io/", '<meta http-equiv="refresh" content="0; url=//bad.net/r">'), (15, "https://r.io?utm_source=z#k", ""),
        (15, "https://r.io?utm_source=z#k", ""), (16, "ftp://x/y/../z?a#b", ""), (17, "http://", "")])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("foo.net", "/zz", "net/", "block"), 3: ("foo.net", "", None, "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.com", "/de/", None, "allow"),
        7: ("example.com", "/de/a", "example.com/de/", "block"), 8: ("a.b.org", "/fr/x", "org/fr/", "allow"),
        9: ("alias.io", "/1", None, "block"), 10: ("alias.io", "/2", None, "block"), 11: ("mixed.io", "/a", None, "allow"),
        12: ("mixed.io", "/b", None, "allow"), 13: ("ok.org", "/fr/1", "org/fr/", "allow"), 14: ("r.io", "/", None, "block"),
        15: ("r.io", "", None, "block"), 16: ("x", "/y/../z", None, "allow"), 17: ("", "", None, "allow")}
    assert url_filters.judge_urls(pages, rules).count() == 18
    moved = spark.createDataFrame([("http://notexample.com/de/", "http://foo.net/zz")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(pages, rules, moved).collect()}[6] == "block"
    assert url_filters.judge_urls(_urls(spark, []), rules).collect() == []
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_all_tags_of_a_page_are_links(spark):
    rules = spark.createDataFrame([("bad.net", "/", "block")], "host string, path string, verdict string")
    bad = "http://bad.net/x"
    htmls = [f'<link rel="canonical"><link rel=canonical href="{bad}">', f'<meta http-equiv="refresh" content="5"><meta http-equiv=refresh content="0; url={bad}">',
             f'<LINK href="{bad}" rel="shortlink canonical">', f"<link rel='canonical' href='/own'><link rel='canonical' href='{bad}'>",
             f'<link rel="non-canonical" href="{bad}">', f'<link rel="next" href="{bad}"><a rel="canonical" href="{bad}">', f'<link data-rel="canonical" href="{bad}">',
             f'<meta http-equiv="refresh" content="0; url=\'{bad}\'"/>', None, ""]
    pages = spark.createDataFrame([(i, f"http://p{i}.org/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, rules).collect()}
    assert [got[i] for i in range(len(htmls))] == ["block"] * 4 + ["allow"] * 3 + ["block"] + ["allow"] * 2


# ---- decontamination

def _contaminated(rows, items):
    import regex

    def cut(t):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = set()
    for d, text in rows:
        w = cut(text)
        for i, item in items:
            b = cut(item)
            k = min(13, len(b))
            for shift in range(-len(b) + 1, len(w)):
                m = [w[j + shift] == b[j] for j in range(max(0, -shift), min(len(b), len(w) - shift))]
                if len(b) >= 7 and any(sum(m[a:a + k]) >= math.ceil(.8 * k - 1e-9) for a in range(len(m) - k + 1)):
                    out.add((d, i))
    return out


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(f"q{rnd.randint(0, 900)}" for _ in range(n))) for i, n in enumerate((14, 20, 40, 59, 9, 7, 3))] + [(90, None), (91, "")]
    texts = []
    for i, item in items[:6]:
        w = item.split()
        for every in (0, 5):
            x = [("zz" if every and k % every == 3 else t) for k, t in enumerate(w)]
            texts.append("before it " * rnd.randint(0, 9) + " ".join(x).upper() + ". after" * rnd.randint(0, 3))
        texts.append(" ".join(t if k % 2 else "no" for k, t in enumerate(w)))  # half changed: clean
        texts.append("Pre, " + ", ".join(w[:13]))
    df = B.awkward(spark, texts)
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, _b string")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = _contaminated([r for r in rows if r[0] != 5], items)
    per = collections.Counter(d for d, _ in want)
    for limits in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 3000}):
        got = decontamination.decontaminate(df, bench, **limits)
        assert B.rows_of(got, "doc_id", "contaminated", "n_items") == sorted(((d, per[d] > 0, per[d]) for d, _ in rows), key=repr)
        kept = decontamination.drop_contaminated(df, bench, **limits)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in rows if not per[d]), key=repr)
    assert len(per) >= 13
    assert not decontamination.decontaminate(df, bench.limit(0)).where("contaminated").count()
    assert decontamination.decontaminate(df.limit(0), bench).collect() == []


# ---- packing

@pytest.mark.parametrize("seed", range(6))
def test_mixture_places_every_token_once(seed):
    for sub in range(25):
        rnd = random.Random(100 * seed + sub)
        totals = [rnd.randint(1, rnd.choice([5, 300, 4000])) for _ in range(rnd.randint(1, 9))]
        targets = None if rnd.random() < .5 else [rnd.choice([0.0, 1.0, 0.5, 0.25]) for _ in totals]
        m = packing.Mixture(totals, targets, rnd.choice([16, 64]))
        seen = np.zeros(m.total, int)
        for s, total in enumerate(totals):
            cuts = sorted({0, total, *(rnd.randint(0, total) for _ in range(total // 40))})
            doc, x, place, size = m.segments(s, np.array(cuts[:-1]), np.diff(cuts))
            assert size.sum() == total
            part, _, length, _, _ = m.sequences(place, size)
            assert length.sum() == total and part.max() < len(place)
            for p, n in zip(place, size):
                seen[p:p + n] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("n, targets", [(3, [0.5, 0.3, 0.2]), (20, None), (200, None), (2000, None), (2000, "given")])
def test_windows_hold_the_target_mixture(n, targets):
    rnd = random.Random(n)
    totals = [3_000_000, 1_000_000, 500_000] if n == 3 else [100_000] * n if n == 200 else [int(10 ** rnd.uniform(0, 5.7)) for _ in range(n)]
    if targets == "given":
        targets = [rnd.choice([1.0, 3.0, 10.0]) for _ in totals]
        totals = [int(50 * t) for t in targets]  # all run dry together
    m = packing.Mixture(totals, targets, 2048)
    share = np.array(totals if n != 3 else targets, float)
    share /= share.sum()
    windows = np.arange(m.count[0])  # one sequence each, whatever the number of sources
    for s in range(n):
        used = m.used(0, s, windows).astype(float)
        assert np.abs(used - share[s] * 2048 * windows).max() < 2 and (np.diff(used) >= 0).all()


def test_mixture_of_many_tokens():
    big = packing.Mixture([3 << 32, 1 << 32], None, 2048)  # products beyond 64 bits
    assert int(big.used(0, 0, np.array([4096]))[0]) == 3 * 4096 * 2048 // 4


def test_packing_round_trip(spark):
    df = B.awkward(spark, ["Some text, with Words. " * (i % 40) for i in range(120)])
    tok = Tokenizer.from_file(WORD_BPE)
    tok.encode_special_tokens = True
    want = collections.Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
    pieces = packing.pack(df, WORD_BPE, width=256).collect()
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.ids)
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.doc_tokens].append((p.start, ids))
    for (d, n), parts in docs.items():
        copies = sum(k for (e, ids), k in want.items() if e == d and len(ids) == n)
        assert sum(len(x) for _, x in parts) == n * copies
        if copies == 1:
            assert want[d, tuple(t for _, x in sorted(parts) for t in x)] == 1
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(n == 256 or n & (n - 1) == 0 for n in lengths)  # no padding at all
    digest = packing.digest(df.where("doc_id <> 9"), WORD_BPE, width=256)
    assert collections.Counter(r.ids_crc32 for r in digest.collect()) == collections.Counter(
        zlib.crc32(p.ids) for p in packing.pack(df.where("doc_id <> 9"), WORD_BPE, width=256).collect())
    loaded = Tokenizer.from_file(WORD_BPE)  # the digest has the ids of the tokenizer as it is loaded
    for r in df.where("doc_id in (9, 4)").collect():
        one = packing.digest(df.where(f"doc_id = {r.doc_id}"), WORD_BPE).collect()
        ids = loaded.encode(r.text, add_special_tokens=False).ids + [1]
        assert sum(p.length for p in one) == len(ids) == one[0].doc_tokens
        for p in one:
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start:p.start + p.length]))
    assert packing.pack(B.awkward(spark, empty=True), WORD_BPE).collect() == []


def test_word_encoder_equals_the_tokenizer():
    texts = [None, "", "It's 3.5kg, isn't it? We'll see...", "ÀÉÎ straße İstanbul ŒUVRE d'été", "naïve naïve", "a b c d\x1ce",
             "<|endoftext|>.", "東京 😀ok ǅ ŉ ſ ﬁ Σας ΣΑΣ", "x" * 3000, "Foo., bar.. baz,. .,.", "ª º µ ÿ ı ɏ ɐ"]
    import pyarrow as pa
    for path in (WORD_BPE,):
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        enc = WordEncoder(path)
        assert enc.short
        assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


# ---- language ID

def test_gradients_by_differences():
    net = lang_id.ByteGru(4, 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (3, 5)).astype(np.uint8), np.array([0, 1, 2])
    _, grads = net.step(x, y)
    for name, w in net.w.items():
        i = tuple(rng.integers(0, s) for s in w.shape)
        i = (int(x[0, 2]), i[1]) if name[0] == "x" else i
        old, loss = w[i], []
        for step in (1e-4, -1e-4):
            w[i] = old + step
            loss.append(net.step(x, y)[0])
        w[i] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - grads[name][i]) < 3e-5


def test_language_id_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = lang_id.identify(docs, docs_per_lang=150)
    right = (got.join(docs, "doc_id").where("held_out and lang is not null")
             .agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0])
    assert right > 0.95
    folds = {r.doc_id: r.held_out for r in got.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in folds.items())
    rows = lang_id.identify(B.awkward(spark), docs_per_lang=5).collect()
    assert len(rows) == B.awkward(spark).count() and all(0 <= r.score <= 1 for r in rows)
    named = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
    assert [named[i] for i in (2, 3, 4, 8)] == ["und"] * 4 and named[1] != "und" and named[6] != "und"
    unlabelled = B.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lang_id.identify(unlabelled).collect()} == {("und", 0.0)}
    assert lang_id.identify(B.awkward(spark, empty=True)).collect() == []


def test_labels_do_not_depend_on_the_batch():
    net = lang_id.ByteGru(8, 3, 2)
    texts = [b"", b"abc", bytes(range(32, 127)) * 3, b"z" * 64]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = lang_id.pooled(net, np.frombuffer(b"".join(texts), np.uint8), at)
    for t, row in zip(texts, together):
        alone = lang_id.pooled(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], row, atol=1e-5)
    assert np.allclose(together[1:].sum(axis=1), 1, atol=1e-5)


# ---- quality rules

def test_quality_rules(spark):
    common = ["Sign up for our news", "Cookie policy applies  HERE", "All rights reserved"]
    own = [" ".join(f"u{i}_{j}" for j in range(60)) for i in range(30)]
    texts = [own[i] + "\n" + common[i % 3] for i in range(30)] + ["\n".join(c + f" w{k}" * 0 for c in common) + " x" * 55 for k in range(1)]
    texts += ["\n".join(common * 8)] * 3 + ["a b c " * 40]
    df = B.awkward(spark, texts)
    args = {"min_docs": 2, "max_share": 0.1}
    got = {r.doc_id: r for r in quality_rules.judge(df, **args).collect() if r.doc_id is not None}
    assert quality_rules.judge(df, **args).count() == df.count()
    assert got[100].n_removed_lines == 1 and got[100].kept and got[100].n_words == 65
    assert got[2].base_failed and not got[2].kept and got[2].n_words == 0 and got[3].line_chars == 0
    assert got[134].base_failed and got[134].n_repeat_words == 120
    assert got[131].n_dup_lines == 21 and not got[131].kept
    for r in got.values():
        text = {x.doc_id: x.text for x in df.collect()}[r.doc_id]
        w = B.words(text)
        count = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if B.words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))
    kept = quality_rules.clean(df, **args)
    assert kept.columns == df.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {d for d, r in got.items() if r.kept} and rows[100] == own[0]
    assert quality_rules.judge(df.limit(0)).collect() == [] and quality_rules.clean(df.limit(0)).collect() == []


def test_line_limits_for_hosts_of_any_size(spark):
    """A small host's footer goes (three documents of ten), one of two documents
    stays; in a large host more than 50 documents are too many, 40 of 800 are not."""
    body = lambda i: " ".join(f"h{i}q{j}" for j in range(60))
    rows = [(i, body(i) + ("\nsmall footer" if i < 3 else "\npair" if i < 5 else ""), "small") for i in range(10)]
    rows += [(1000 + i, body(1000 + i) + ("\nlarge footer" if i < 51 else "\nforty" if i < 91 else ""), "large") for i in range(800)]
    menu = "\n".join(" ".join(f"m{k}e{j}" for j in range(8)) for k in range(9))
    rows += [(5000 + i, menu + f"\nown line {i}", "menus") for i in range(4)]
    df = spark.createDataFrame([(*r[:2], "en", r[2], 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert [got[i].n_removed_lines for i in (0, 2, 3, 9)] == [1, 1, 0, 0]
    assert [got[1000 + i].n_removed_lines for i in (0, 50, 51, 90, 799)] == [1, 1, 0, 0, 0]
    depleted = [got[5000 + i] for i in range(4)]  # the method's own verdict: little but the menu
    assert all(r.n_removed_lines == 9 and not r.base_failed and not r.kept for r in depleted)
    assert all(got[i].kept for i in (0, 3, 9, 1000, 1799))


def test_repeat_words_of_texts_beyond_the_packed_form(spark, monkeypatch):
    df = B.awkward(spark, ["a b c d a b c e", "p q r " * 30])
    want = B.rows_of(quality_rules.judge(df), "doc_id", "n_repeat_words")
    monkeypatch.setattr(quality_rules, "_PACKED_WORDS", 4)
    assert B.rows_of(quality_rules.judge(df), "doc_id", "n_repeat_words") == want


# ---- chat formatting

def _turns(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, start long")


def test_chat_round_trip(spark):
    rnd = random.Random(9)
    bits = ["###", "#", "</turn>", "\\", "<\\/turn>", ": ", "\n", "é東😀", "<|endoftext|>", " ", "### User: ", "x"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a: b"]), rnd.choice([None, "", "".join(rnd.choices(bits, k=rnd.randint(1, 20)))]))
            for c in range(25) for t in range(rnd.randint(1, 6))]
    rows += [(30, 0, "user", "tie b"), (30, 0, "user", "tie a"), (30, 0, "assistant", "tie"), (30, None, "user", "first"), (None, 0, "assistant", "no id"),
             (31, 0, "assistant", "same"), (31, 0, "assistant", "same"), (32, 0, "assistant", "y" * 200_000)]
    formatted = chat.format_chats(chat.with_probe(_turns(spark, rows)), BYTE_BPE)
    got = {r.conv_id: r for r in chat.read_back(formatted, BYTE_BPE).collect()}
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{x[3]}\n{x[5]}\n" for x in turns)
        learnt = "".join(x[5] for x in turns if x[3] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in formatted.collect():
        ids, loss = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.loss, np.int8)
        assert len(ids) == len(loss) and set(loss) <= {0, 1}
    texts = chat.formatted_text(formatted, BYTE_BPE).collect()
    for r in texts:  # no mark can be faked by a content
        assert r.formatted.count("###") == 1 and r.formatted.count("</turn>") == 1
    total = collections.Counter()
    for r in texts:
        total[r.conv_id] += len(r.formatted)
    assert all(total[c] == got[c].formatted_chars for c in got)
    starts = collections.defaultdict(list)
    for r in formatted.collect():
        starts[r.conv_id].append((r.turn_no, r.start, len(r.ids) // 4))
    for parts in starts.values():
        at = 0
        for i, (no, start, n) in enumerate(sorted(parts)):
            assert (no, start) == (i, at)
            at += n
    assert chat.format_chats(_turns(spark, []), BYTE_BPE).collect() == []


def test_role_and_content_cannot_be_mistaken(spark):
    turns = [(0, 0, "a: b", "c"), (1, 0, "a", "b: c"), (2, 0, "a\\: b", "c"), (3, 0, None, ": a: b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.formatted for r in chat.formatted_text(chat.format_chats(df, BYTE_BPE), BYTE_BPE).collect()}
    assert len(set(out.values())) == 4
    for conv, _, role, text in turns:
        body = out[conv][len(chat.MARKS[0]):-len(chat.MARKS[2])]
        found = re.match(r"(?s)((?:[^\\:]|\\.)*): (.*)", body)
        assert (chat.unescape(found[1]), chat.unescape(found[2])) == (role or "", text)


def test_escape_is_reversible():
    rnd = random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choices(["#", "\\", "<", "/", "</turn>", "###", "t", "\n"], k=rnd.randint(0, 12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and "###" not in out and "</turn>" not in out
