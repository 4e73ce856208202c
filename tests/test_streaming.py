"""Resumable scoring: stop after one file, restart, nothing lost or doubled."""
import os
import tempfile

from pyspark.sql import functions as F

from answerlab.plans.q_scoring import REPLY_LABELS, rule_scorer
from answerlab.streaming import streams as ST


def test_score_stream_restart_exact(spark):
    root = tempfile.mkdtemp(prefix="answerlab-stream-")
    src, sink, ckpt = (os.path.join(root, n) for n in ("src", "sink", "ckpt"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
                                  F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    schema = docs.schema
    docs.where("doc_id < 30").coalesce(1).write.mode("append").parquet(src)
    ST.score_stream(spark, src, schema, rule_scorer, ["doc_id", "lang", "text"], REPLY_LABELS, sink, ckpt)
    assert spark.read.parquet(sink).count() == 30
    docs.where("doc_id >= 30").coalesce(1).write.mode("append").parquet(src)   # new file arrives
    ST.score_stream(spark, src, schema, rule_scorer, ["doc_id", "lang", "text"], REPLY_LABELS, sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == 60 and out.select("doc_id").distinct().count() == 60


def test_stream_confusion_equals_batch(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    stream = sorted(tuple(r) for r in E.queries()["t4_stream_confusion"](spark, sf).collect())
    batch = sorted(tuple(r) for r in E.queries()["t4_confusion_by_window"](spark, sf).collect())
    assert stream == batch


def test_scorer_errors_are_isolated(spark):
    from answerlab.operators.scoring import score_table
    df = spark.createDataFrame([(1, "fine text"), (2, "bad $$$ text"), (3, "the end")], "doc_id long, text string")
    out = {r["doc_id"]: (r["raw_output"], r["pred_label"]) for r in
           score_table(df, rule_scorer, ["doc_id", "text"], REPLY_LABELS).collect()}
    assert out[2] == ("ERROR: unreadable answer", "PARSE_ERROR")
    assert out[1] == ("non-reply", "Clear Non-Reply")


def _score(spark, root, docs, **kw):
    ST.score_stream(spark, f"{root}/src", docs.schema, rule_scorer, ["doc_id", "text"], REPLY_LABELS, f"{root}/sink", f"{root}/ckpt", **kw)
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in spark.read.parquet(f"{root}/sink").collect())


def test_a_key_is_scored_once_across_files_and_restarts(spark):
    root = tempfile.mkdtemp(prefix="answerlab-stream-")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    none = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text")
    (docs.where("doc_id < 12").union(none)).coalesce(1).write.mode("append").parquet(f"{root}/src")
    docs.where("doc_id < 5").union(none).coalesce(1).write.mode("append").parquet(f"{root}/src")  # again, in another file
    done = spark.createDataFrame([(2,), (3,)], "doc_id long")
    want = [(False, 0)] + [(True, i) for i in range(12) if i not in (2, 3)]
    assert _score(spark, root, docs, keys=["doc_id"], done=done, max_files_per_trigger=1) == want
    docs.where("doc_id between 8 and 15").coalesce(1).write.mode("append").parquet(f"{root}/src")  # after a restart: 8 to 11 came before
    want = [(False, 0)] + [(True, i) for i in range(16) if i not in (2, 3)]
    assert _score(spark, root, docs, keys=["doc_id"], done=done) == want


def test_keys_are_forgotten_behind_the_horizon(spark):
    root = tempfile.mkdtemp(prefix="answerlab-stream-")
    schema = "doc_id long, text string, at timestamp"
    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) at") \
            .coalesce(1).write.mode("append").parquet(f"{root}/src")
        shape = spark.createDataFrame([], schema)
        return _score(spark, root, shape, keys=["doc_id"], event_time="at", horizon="1 hour", max_files_per_trigger=1)
    assert put([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:10:00")]) == [(True, 1)]
    assert put([(1, "a", "2024-01-01 00:20:00"), (2, "b", "2024-01-01 00:30:00")]) == [(True, 1), (True, 2)]


def test_late_rows_are_kept_and_counted(spark):
    root = tempfile.mkdtemp(prefix="answerlab-late-")
    files = [[("2024-01-01 10:00:00", "a", "a"), ("2024-01-02 10:00:00", "a", "b")], [("2024-01-05 12:00:00", "b", "b")],
             [("2024-01-01 11:00:00", "a", "a"), ("2024-01-04 01:00:00", "a", "a"), (None, "c", "c")], [("2024-01-06 00:00:00", "b", "a")]]
    stream_schema = "ts timestamp, true_label string, pred_label string"
    for rows in files:
        spark.createDataFrame(rows, "ts string, true_label string, pred_label string").selectExpr("cast(ts as timestamp) ts", "true_label", "pred_label") \
            .coalesce(1).write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(stream_schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")  # a restart for each file
        ST.run_counted_confusion(stream, f"{root}/changes", f"{root}/late", f"{root}/marks", f"{root}/ckpt")
    got = {(r.window_start, r.true_label, r.pred_label): (r.n_kept, r.n_late) for r in ST.kept_and_late(spark, f"{root}/changes", f"{root}/late").collect()}
    assert got == {("2024-01-01 00:00:00", "a", "a"): (1, 1), ("2024-01-02 00:00:00", "a", "b"): (1, 0), ("2024-01-05 00:00:00", "b", "b"): (1, 0),
                   ("2024-01-04 00:00:00", "a", "a"): (1, 0), (None, "c", "c"): (0, 1), ("2024-01-06 00:00:00", "b", "a"): (1, 0)}
    assert sum(k + n for k, n in got.values()) == sum(map(len, files))
    late = spark.read.parquet(f"{root}/late")
    assert late.count() == 2 and {"ts", "true_label", "pred_label", "batch_id"} == set(late.columns)
