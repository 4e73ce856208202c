"""Substring, line and near-duplicate removal against brute force."""

import collections
import random

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.llm import line_dedup, near_dedup, repeats, substring_dedup
from answerlab.llm import words as W
from answerlab.llm.components import components
from answerlab.llm.repeats import runs


def _texts(seed, n=60, lines=False):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    passage = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(6, 25))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passage) if rnd.random() < 0.4 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30))))
        out.append(("\n" if lines else " ").join(parts) + rnd.choice(["", "\n", "  "]))
    return out + out[:5]


FORMS = pytest.mark.parametrize("sizes, fan", [({}, 8), ({"chunk_bytes": 700, "bucket_bytes": 900}, 8), ({"chunk_bytes": 700, "bucket_bytes": 900}, 3),
                                               ({"chunk_bytes": 300, "bucket_bytes": 5000}, 2)])


@FORMS
def test_substring_dedup_equals_brute_force(spark, monkeypatch, sizes, fan):
    monkeypatch.setattr(repeats, "FAN_BITS", fan)
    df = B.awkward(spark, _texts(1))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y))
                   for (d, _), (w, g) in zip(rows, B.substring_removed([t for _, t in rows], 7))), key=repr)
    got = substring_dedup.remove_repeats(df, width=7, **sizes)
    assert got.columns == df.columns + ["n_words", "n_removed", "removed", "kept_text"]
    out = [tuple(r) for r in got.collect()]
    n = len(df.columns)
    assert sorted(((r[0], r[n], r[n + 1], r[n + 3]) for r in out), key=repr) == want
    assert all(r[n + 1] == sum(s.end - s.start for s in r[n + 2]) for r in out)


def test_substring_dedup_digest_and_empty_table(spark):
    assert substring_dedup.digest(B.awkward(spark, empty=True)).collect() == []
    got = {r.doc_id: r for r in substring_dedup.digest(B.awkward(spark)).collect()}
    assert got[3].n_words == 0 and got[5].n_removed == got[5].n_words == 30_000  # the long text is there twice


def test_announced_rows_are_bounded_by_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FAN_BITS", 2)
    counts = []
    for n in (60, 240):
        df = spark.createDataFrame([(i, " ".join(f"{i}w{j}" for j in range(200))) for i in range(n)], "doc_id long, text string")
        rows, bits = repeats.chunked(df, "text", 1500, 1500)
        chunks = rows.select("chunk").distinct().count()

        def hashes(table):
            data, at = W.text_bytes(table["c1"])
            starts, ends, first = W.spans(data, at)
            pos, values = W.window_hashes(W.span_hashes(data, starts, ends), first, 7)
            return values, pos

        sent, steps = repeats.announcements(rows, bits, hashes)
        assert len(steps) == -(-bits // 2) and max(steps) <= 2 and sum(steps) == bits
        assert all(df.count() <= 4 * 4 * chunks for df in sent) and sent[0].count() <= 4 * chunks
        counts.append(sent[0].count() / chunks)
    assert max(counts) <= 4


def test_ids_of_any_type(spark):
    df = B.awkward(spark, _texts(4, lines=True)).coalesce(1)
    ids = {"string": "lpad(cast(doc_id as string), 9, '0')", "decimal": "cast(doc_id as decimal(20, 2))", "date": "date_add(date'2000-01-01', cast(doc_id as int))",
           "binary": "cast(lpad(cast(doc_id as string), 9, '0') as binary)"}
    for sizes in ({}, {"chunk_bytes": 700, "bucket_bytes": 900}):
        want = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df, **sizes).select("doc_id", "text").collect())
        for text in ids.values():
            own = df.select(F.expr(text).alias("key"), "text", "doc_id")
            got = line_dedup.dedup_lines(own, "key", **sizes).select("doc_id", "text").collect()
            assert collections.Counter((r.doc_id, r.text) for r in got) == want


@FORMS
def test_line_dedup_equals_brute_force(spark, monkeypatch, sizes, fan):
    monkeypatch.setattr(repeats, "FAN_BITS", fan)
    df = B.awkward(spark, _texts(2, lines=True)).coalesce(1)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, B.lines_removed(rows))), key=repr)
    got = line_dedup.dedup_lines(df, **sizes)
    assert got.columns == df.columns + ["n_lines", "n_removed_lines"]
    assert sorted(((r[0], r[1], r[-1]) for r in got.collect()), key=repr) == want
    assert line_dedup.dedup_lines(B.awkward(spark, empty=True)).collect() == []


def test_near_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"t{rnd.randint(0, 4000)}" for _ in range(rnd.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 9))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randint(0, 10 ** 6)}"
            texts.append(" ".join(copy).upper() if rnd.random() < 0.3 else "  ".join(copy))
    df = B.awkward(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets, part = B.near_components(rows, 2)
    least = collections.defaultdict(list)
    for (d, _), p in zip(rows, part):
        least[p].append(d)
    want = sorted(((d, len(s), min((x for x in least[p] if x is not None), default=None) if s else d) for (d, _), s, p in zip(rows, sets, part)), key=repr)
    for limits in ({}, {"broadcast_rows": 0}):
        got = near_dedup.near_components(df, width=2, **limits)
        assert B.rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert near_dedup.digest(B.awkward(spark, empty=True)).collect() == []


def test_one_document_of_each_group_stays(spark):
    texts = [" ".join(f"a{i}" for i in range(40))] * 3 + [" ".join(f"b{i}" for i in range(40))]
    df = B.awkward(spark, texts)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    ids = collections.Counter(r.doc_id for r in rows)
    assert ids[100] == 1 and ids[101] == ids[102] == 0 and ids[103] == 1 and ids[5] == 1
    assert ids[2] == ids[3] == ids[4] == 1  # texts without words are linked with nothing


def test_open_buckets_find_links_that_stars_miss(spark):
    """A chain: each text is near the next only, so centres reach few members."""
    base = [f"c{i}" for i in range(200)]
    texts = [" ".join(base[i * 6:] + [f"d{i}_{j}" for j in range(i * 6)]) for i in range(12)]
    df = B.awkward(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    _, part = B.near_components(rows, 1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(df, width=1).collect()}
    ids = [d for d, _ in rows]
    assert all(got[d] == min(e for e, q in zip(ids, part) if q == p and e is not None) for d, p in zip(ids, part) if d is not None and d >= 100)


def test_bayes_bounds_and_sequential_test():
    least = near_dedup.least_matches(0.8, 1e-6)
    assert len(least) == 4 and least == sorted(least) and 60 < least[-1] < 100
    one = np.arange(128, dtype=np.uint32)
    other = one.copy()
    other[::3] = 9999
    rows, matches = near_dedup._may_link(one, np.stack([one, other, one + 1]), least)
    assert rows.tolist() == [0, 1] and matches.tolist()[0] == 128


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3), (7, None), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(80)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hash_helpers():
    rnd = np.random.default_rng(0)
    values = np.unique(rnd.integers(0, 2 ** 64, 5000, dtype=np.uint64))
    for v in (values, values[:1], values[:0], np.unique(values >> np.uint64(40))):
        assert (W.unpack_sorted(W.pack_sorted(v)) == v).all() and len(W.unpack_sorted(W.pack_sorted(v))) == len(v)
    flags = np.array([1, 1, 0, 1, 1, 1, 0, 1], bool)
    doc, lo, hi = runs(flags, np.array([0, 4, 4, 8]))
    assert list(zip(doc.tolist(), lo.tolist(), hi.tolist())) == [(0, 0, 2), (0, 3, 4), (2, 0, 2), (2, 3, 4)]
    old = W._BLOCK
    x = rnd.integers(0, 2 ** 64, 500, dtype=np.uint64)
    whole = W.window_hashes(x, np.array([0, 200, 200, 500]), 7)
    try:
        W._BLOCK = 64
        again = W.window_hashes(x, np.array([0, 200, 200, 500]), 7)
    finally:
        W._BLOCK = old
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all() and len(whole[0]) == 194 + 294


def test_digest_keeps_one_hash_per_text(spark):
    got = line_dedup.digest(B.awkward(spark))
    want = B.awkward(spark).select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).collect()
    changed = {5}  # the long text is one line: no window, so even its copy stays
    assert B.rows_of(got.where(~F.col("doc_id").isin(*changed)), "doc_id", "kept_sha256") == sorted(
        ((r.doc_id, r.h) for r in want if r.doc_id not in (None, 5)), key=repr)
