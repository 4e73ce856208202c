"""Hashed vector index, and vectors that cannot be searched."""

import random

import numpy as np
import pytest

from answerlab.operators import neighbours as N
from answerlab.operators import vector_index as VI

SCHEMA = "vec_id long, embedding array<float>, label int"


def _exact(queries, corpus, k):
    out = {}
    for i, v in queries:
        scored = sorted(((-round(float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), 6), j) for j, w in corpus))[:k]
        out[i] = [(j, -s) for s, j in scored]
    return out


def _vectors(n, dim, seed, clusters=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(max(1, clusters), dim)) * 3
    return [(i, [float(x) for x in rnd.normal(size=dim) + (centres[i % clusters] if clusters else 0)]) for i in range(n)]


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_exact_scores(spark, clusters):
    corpus, queries = _vectors(900, 16, 1, clusters), _vectors(60, 16, 2, clusters)
    c = spark.createDataFrame([(i, v, i % 3) for i, v in corpus], SCHEMA)
    q = spark.createDataFrame([(10_000 + i, v, 0) for i, v in queries], SCHEMA)
    got = VI.hashed_neighbours(q, c, 5, c_cols=["label"], tables=8, max_block=300, max_queries=40)
    assert got.columns == ["query_id", "corpus_id", "score", "label", "rank"]
    want = _exact([(10_000 + i, v) for i, v in queries], corpus, 5)
    rows = got.collect()
    assert len(rows) == 300 and len({(r.query_id, r.corpus_id) for r in rows}) == 300
    found = 0
    for i, near in want.items():
        mine = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.corpus_id) for r in mine] == sorted((-r.score, r.corpus_id) for r in mine)
        for r in mine:
            v = dict(corpus)[r.corpus_id]
            assert abs(r.score - float(np.dot(np.float32(dict(queries)[i - 10_000]), np.float32(v)))) < 1e-4 and r.label == r.corpus_id % 3
        found += len({r.corpus_id for r in mine} & {j for j, _ in near})
    assert found >= 0.9 * 300
    row = VI.recall_against(got, N.nearest_neighbours(q, c, 5)).first()
    assert (row.n_queries, row.n_exact) == (60, 300) and row.n_found >= found and row.recall >= 0.9


def test_probes_follow_the_data():
    """Clustered vectors need fewer probes than vectors without structure."""
    rnd = np.random.default_rng(0)
    planes = rnd.normal(size=(16, 17, 8))
    x = rnd.normal(size=(50, 16))
    first = VI._probes(x, planes, 1024 if planes.shape[2] >= 10 else 256)
    assert all(len(set(row)) == 256 for table in first[:3] for row in table)  # every bucket once
    reach = float(np.sqrt((x * x).sum(axis=1).max()))
    near = VI._codes(x, planes, reach)
    assert near.shape == (50, 16) and near.max() < 256


def test_copies_are_one_vector(spark):
    """A vector that most rows hold: the smallest ids win, nothing is quadratic."""
    same = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, same if i % 3 else [random.Random(i).gauss(0, 1) for _ in range(4)], 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = VI.hashed_neighbours(df.where("vec_id < 30"), df, 3)
    want = _exact([(i, v) for i, v, _ in rows if i < 30], [(i, v) for i, v, _ in rows], 3)
    mine = {}
    for r in got.collect():
        mine.setdefault(r.query_id, []).append((r["rank"], r.corpus_id))
    copies = [i for i, v, _ in rows if i < 30 and v == same]
    # a query equal to the copies sees them all; only longer vectors come before
    hits = sum(len({c for _, c in mine[i]} & {j for j, _ in want[i]}) for i in copies)
    assert hits >= 0.9 * 3 * len(copies)


@pytest.mark.parametrize("search", [N.nearest_neighbours, VI.hashed_neighbours])
def test_vectors_that_cannot_be_searched(spark, search):
    good = [(i, v, 0) for i, v in _vectors(40, 4, 5)]
    odd = [(100, None, 0), (101, [1.0, None, 2.0, 3.0], 0), (102, [1.0, 2.0], 0), (103, [], 0), (104, [float("nan")] * 4, 0)]
    df = spark.createDataFrame(good + odd, SCHEMA)
    rows = search(df, df, 2).collect()
    assert {r.query_id for r in rows} == set(range(40)) and {r.corpus_id for r in rows} <= set(range(40))
    assert search(df.where("vec_id >= 100 and vec_id < 102"), df, 2).collect() == []
    assert search(df, df.where("embedding is null"), 2).collect() == []
    assert search(df, df.limit(0), 2).collect() == []
    table = N.diverse_neighbours(df, df, "label", k=2) if search is N.nearest_neighbours else None
    assert table is None or table.count() == 40
