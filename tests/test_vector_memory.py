"""What a Python task of the vector searches holds does not grow with its batch."""

import tracemalloc

import numpy as np
import pandas as pd

from answerlab.operators import neighbours as N
from answerlab.operators import vector_index as VI


def _peak(run, *batches):
    """(most bytes held while the parts go by, rows of all parts)."""
    tracemalloc.start()
    rows = sum(len(part) for part in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, rows


def _frame(col, n, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return pd.DataFrame({"query_id": np.arange(n), col: list(x), "_t": np.nan}), x


def test_hashed_queries_and_corpus_stay_small():
    pdf, _ = _frame("_qv", 3000)
    planes = np.random.default_rng(1).normal(size=(16, 17, 10))
    peak, rows = _peak(VI._hash_queries(planes, 200), pdf)
    assert rows == 3000 and peak < 150e6  # a row for each query; 1.1 GB held before
    pdf, _ = _frame("_cv", 3000)
    peak, rows = _peak(VI._hash_corpus(planes, 10.0), pdf)
    assert rows == 3000 and peak < 50e6


def test_exact_probes_are_one_row_a_query():
    pdf, x = _frame("_qv", 10_000)
    pivots = np.random.default_rng(2).normal(size=(400, 16))
    tile_of = np.arange(400) % 50
    radii = {b: 100.0 for b in range(400)}
    run = N._probe_tiles(pivots, radii, tile_of, 2, True)
    parts = list(run(iter([pdf])))
    assert sum(map(len, parts)) == 10_000 and all(len(p) * 400 <= N.CELLS for p in parts)
    assert all(len(t) == 48 and len(set(t)) == 48 for p in parts for t in p["tiles"])  # 2 of 50 are pass 1's
    assert _peak(run, pdf)[0] < 60e6


def test_block_of_many_queries_equals_one_product():
    q, x = _frame("_qv", 3000, seed=3)
    c, y = _frame("_cv", 900, seed=4)
    c = c.rename(columns={"query_id": "corpus_id"})
    out = N._block_topk(3, [])(q, c)
    want = np.argsort(-np.round(x @ y.T, 6), axis=1, kind="stable")[:, :3]
    assert (out.sort_values(["query_id", "score"], ascending=[True, False], kind="stable")["corpus_id"].to_numpy().reshape(-1, 3) == want).all()


def test_shape_follows_the_data(spark):
    """Vectors without structure get few large buckets (few copies of a query sent)."""
    rnd = np.random.default_rng(5)
    planes = np.random.default_rng(17).normal(size=(16, 33, 8))

    def shape(x):
        df = spark.createDataFrame([([float(v) for v in row],) for row in x], "_cv array<float>")
        reach = float(np.sqrt((x * x).sum(axis=1).max()))
        return VI.fit_probes(df.limit(400).withColumnRenamed("_cv", "_qv"), df, planes, reach, 5, 0.95, 100, 400, len(x), 4096)

    tables, bits, probes = shape(rnd.normal(size=(4000, 32)))
    assert tables * probes <= 16
    centres = rnd.normal(size=(60, 32)) * 5
    tables, bits, probes = shape(np.repeat(centres, 70, axis=0) + rnd.normal(size=(4200, 32)) * 0.05)
    assert tables * probes * 2 <= 1 << bits  # at most half of the corpus is scored
