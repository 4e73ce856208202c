"""Text steps whose tasks must not grow with the table or with the length of texts."""

import glob

import pyarrow as pa

from answerlab.operators import balance as B
from answerlab.operators import scoring as SC
from answerlab.operators import similarity
from answerlab.plans import q_scoring as Q
from conftest import SF_SMALL


def test_a_scorer_gets_bounded_slices():
    texts = ["x" * 10_000] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["id", "text"])
    sizes = []

    def scorer(pdf):
        sizes.append(int(pdf["text"].str.len().sum()))
        return pdf["text"].str[:3]

    out = list(SC._scored_batches(scorer, ["id"])(iter([batch])))
    assert max(sizes) <= SC.SLICE_BYTES * 1.1 and sum(sizes) == 30_000_000  # one call with all 30 MB before
    assert [r for b in out for r in b.column("id").to_pylist()] == list(range(3000))
    assert all(b.schema.names == ["id", "raw_output"] for b in out)


def test_stream_files_follow_the_table(spark, monkeypatch):
    """More scan tasks, more files; 4 of any size before."""
    seen = []
    monkeypatch.setattr(Q.ST, "score_stream", lambda spark, src, *a, **k: seen.append((len(glob.glob(f"{src.removeprefix('file:')}/*.parquet")), k["max_files_per_trigger"])))
    monkeypatch.setattr(Q, "_scored_cols", lambda df: df)
    monkeypatch.setattr(Q, "_files", lambda df, least: 9)
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, _old=type(spark.read).parquet: _old(self, *p) if "stream-sink" not in p[0] else None)
    Q.q_t3(spark, SF_SMALL)
    assert seen == [(9, 5)]
    monkeypatch.undo()
    assert Q._files(spark.range(0, 100, 1, 7), 4) == 7 and Q._files(spark.range(0, 100, 1, 2), 4) == 4


def test_overlap_counts_characters_beyond_the_first_plane(spark):
    """An emoji is one character (its halves must not match another's)."""
    pairs = [(0, "\U0001F600ab", "\U0001F601ba"), (1, "", ""), (2, None, "x"), (3, "AAb", "aab"), (4, "\U0001F600", "\U0001F600")]
    got = {r.id: round(r.surface_bound, 6) for r in B.with_surface_bound(spark.createDataFrame(pairs, "id int, a string, b string"), "a", "b").collect()}
    assert got == {0: round(4 / 6, 6), 1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}
    assert B.character_overlap("aabc", "abbd") == 2 and similarity.sequence_ratio("", "") == 1.0
