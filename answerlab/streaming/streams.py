"""Structured Streaming: resumable scoring (T3) and live confusion counts (T4).

T3: a file stream is scored by the same ``mapInPandas`` scorer as C1 and
written to a file sink with a checkpoint; the sink's commit log and the
source offsets make a stop/restart exact (no loss, no duplicate).
``trigger(availableNow=True)`` drains what is there and stops.

Files are not the only thing that comes twice: with ``keys``, a row key that was
seen before, in another file or an earlier run, is not scored again. Keys are kept
in the query's keyed state (part of the checkpoint), for good or, with
``event_time`` and ``horizon``, for as long as duplicates are awaited, so that the
state stays bounded. Rows scored elsewhere are left out by ``done`` (T1).

T4: event-time windows with a watermark, counts per (window, truth,
prediction), update mode; each micro-batch's updated rows are appended to a
change table with the batch id, and the latest row per key is the current
count. Rows later than the watermark are dropped by Spark, without a count.
``run_counted_confusion`` keeps them: every row is either counted in its window or
written to a side table of late rows, so kept + late = all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlab.operators.scoring import Scorer, pending, score_table


def score_stream(spark: SparkSession, src: str, schema, scorer: Scorer, keep: Sequence[str], labels: Sequence[str],
                 sink: str, checkpoint: str, max_files_per_trigger: int | None = None, answer: str | None = None,
                 glob: str | None = None, tagged: bool = False, keys: Sequence[str] | None = None, done: DataFrame | None = None,
                 event_time: str | None = None, horizon: str | None = None) -> None:
    """Score every new file of ``src`` into ``sink``; safe to stop and run
    again with the same ``checkpoint``. ``tagged`` as in C1. With ``keys``, the
    first row of a key is scored and later ones are not (of several in one batch,
    any); null is a key like any other. ``done``: a table with ``keys`` of rows
    that are scored already. With ``event_time`` and ``horizon`` (an interval) a key is
    forgotten once it is older than that."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(src)
    if keys and done is not None:
        stream = pending(stream, done, keys)
    if keys and event_time and horizon:
        stream = stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))
    elif keys:
        stream = stream.dropDuplicates(list(keys))
    scored = score_table(stream, scorer, keep, labels, answer, tagged=tagged)
    q = (scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def window_confusion(stream: DataFrame, ts: str = "ts", truth: str = "true_label", pred: str = "pred_label",
                     window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """T4 (plan): counts per event-time window, truth and prediction."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n")))


def run_window_confusion(agg: DataFrame, changes: str, checkpoint: str) -> None:
    """T4 (run): update mode; every micro-batch appends its updated rows with
    the batch id to ``changes`` (parquet)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "true_label", "pred_label", "n", F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("append").parquet(changes))

    q = (agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def current_counts(spark: SparkSession, changes: str) -> DataFrame:
    """Latest count per (window, truth, prediction) from the change table."""
    w = Window.partitionBy("window_start", "true_label", "pred_label").orderBy(F.desc("batch_id"))
    return (spark.read.parquet(changes).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r", "batch_id"))


def batch_window_confusion(df: DataFrame, ts: str = "ts", truth: str = "true_label", pred: str = "pred_label",
                           window: str = "1 day") -> DataFrame:
    """T4 batch twin: the same counts over a static table."""
    return (df.groupBy(F.window(ts, window).alias("w"), F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "true_label", "pred_label", "n"))


def run_counted_confusion(stream: DataFrame, changes: str, late: str, marks: str, checkpoint: str, ts: str = "ts", truth: str = "true_label",
                          pred: str = "pred_label", window: str = "1 day", watermark: str = "1 day") -> None:
    """T4 with late rows kept. A row is late if its window ended at or before the
    watermark of its micro-batch: the newest event time of all batches before,
    less ``watermark``. Each batch writes its own folder of three tables: counts to
    ``changes``, whole late rows to ``late``, its newest event time to ``marks``. A
    batch that is run again after a failure writes the same folders again, so
    nothing is counted twice. Rows without an event time are late."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = (spark.read.schema("newest timestamp, batch_id long").parquet(marks).where(F.col("batch_id") < batch_id)
                  .agg(F.max("newest") - F.expr(f"interval {watermark}")).first()[0]) if batch_id else None  # one row a batch
        rows = batch.withColumn("_w", F.window(ts, window))  # has no row for a null time
        closed = F.coalesce(F.col("_w.end") <= F.lit(before).cast("timestamp"), F.lit(False))
        rows.where(closed).drop("_w").unionByName(batch.where(F.col(ts).isNull())).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        (rows.where(~closed).groupBy(F.date_format(F.col("_w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                     F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
         .agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}"))
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def kept_and_late(spark: SparkSession, changes: str, late: str, ts: str = "ts", truth: str = "true_label", pred: str = "pred_label",
                  window: str = "1 day") -> DataFrame:
    """``window_start, true_label, pred_label, n_kept, n_late`` of all rows that came."""
    labels = ["window_start", "true_label", "pred_label"]
    kept = spark.read.parquet(changes).groupBy(*labels).agg(F.sum("n").alias("n_kept"), F.lit(0).cast("long").alias("n_late"))
    rows = spark.read.parquet(late)
    start = F.date_format(F.col("_w.start"), "yyyy-MM-dd HH:mm:ss")
    placed = (rows.withColumn("_w", F.window(ts, window)).withColumn("window_start", start).drop("_w")
              .unionByName(rows.where(F.col(ts).isNull()).withColumn("window_start", F.lit(None).cast("string"))))
    missed = (placed.groupBy("window_start", F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
              .agg(F.lit(0).cast("long").alias("n_kept"), F.count(F.lit(1)).alias("n_late")))
    return kept.unionByName(missed).groupBy(*labels).agg(F.sum("n_kept").alias("n_kept"), F.sum("n_late").alias("n_late"))
