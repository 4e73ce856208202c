"""Sources and sinks (S1-S6, S8 file side).

Everything is a plain Spark reader or writer with an explicit schema; result
tables are written partitioned by run so that a reader can prune to one run.
Scratch output goes under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster), never a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.session import checkpoint_dir

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("interview_question", T.StringType()),
    T.StructField("interview_answer", T.StringType()), T.StructField("official_label", T.StringType()),
    T.StructField("evasion_label", T.StringType()), T.StructField("annotator1", T.StringType()),
    T.StructField("annotator2", T.StringType()), T.StructField("annotator3", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("model_key", T.StringType()), T.StructField("bal_name", T.StringType()),
    T.StructField("aug_name", T.StringType()), T.StructField("loss_name", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("extra", T.StructType([
        T.StructField("model_id", T.StringType()), T.StructField("max_length", T.LongType()),
        T.StructField("num_epochs", T.LongType()), T.StructField("focal_gamma", T.DoubleType()),
        T.StructField("task", T.StringType()), T.StructField("train_size", T.LongType())])),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("answer_snippet", T.StringType()),
    T.StructField("true_label", T.StringType()), T.StructField("pred_label", T.StringType()),
    T.StructField("raw_output", T.StringType()),
])


def _csv_options(rw):
    """Header, double-quote quoting, and texts kept exactly (no trimming)."""
    return (rw.option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_examples(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                  fmt: str = "parquet", names: dict[str, str] | None = None) -> DataFrame:
    """Example table with an explicit schema (no inference); ``names`` maps
    the columns of the file to the library's names."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path).withColumnsRenamed(names or {})


def read_runs(spark: SparkSession, path: str, measure: str = "macro_f1", one_per_file: bool = False) -> DataFrame:
    """Every run record of a folder (one JSON object per line, as
    ``write_runs`` writes them; with ``one_per_file`` one object per file, over
    any number of lines), best first by ``metrics[measure]`` (missing = 0.0)."""
    runs = spark.read.option("multiLine", one_per_file).schema(RUN_SCHEMA).json(path)
    return runs.orderBy(F.desc(F.coalesce(F.col("metrics")[measure], F.lit(0.0))))


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | str = PREDICTION_SCHEMA) -> DataFrame:
    """S3: prediction CSV with header; quoted fields may hold line breaks. Such a
    file cannot be split: one file is one task. ``write_predictions`` bounds the
    rows of a CSV file for that; large tables belong in Parquet, its default."""
    return _csv_options(spark.read.schema(schema).option("multiLine", True)).csv(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "run_id",
                      mode: str = "overwrite", csv_rows: int = 200_000) -> str:
    """Save a result table; partitioned by run so readers prune to one run.
    A CSV file has at most ``csv_rows`` rows, so that its reader's task stays small."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w = _csv_options(w).option("maxRecordsPerFile", csv_rows)
    w.format(fmt).save(path)
    return path


def run_records(metrics: DataFrame, task_col: str = "task") -> DataFrame:
    """S5 (record side): one record per run with the name
    ``{c|e}__model__bal__aug__loss`` (c for the coarse task), metrics as a
    map of doubles and an ISO timestamp. ``metrics`` has model_key, bal_name,
    aug_name, loss_name, extra (struct with ``task``) and measure columns."""
    keys = ["model_key", "bal_name", "aug_name", "loss_name", "extra"]
    measures = [c for c in metrics.columns if c not in keys + [task_col]]
    mp = F.map_from_arrays(F.array(*[F.lit(m) for m in measures]),
                           F.array(*[F.col(m).cast("double") for m in measures]))
    mp = F.map_filter(mp, lambda k, v: v.isNotNull())
    prefix = F.when(F.col("extra.task") == "coarse", F.lit("c")).otherwise(F.lit("e"))
    name = F.concat_ws("__", prefix, "model_key", "bal_name", "aug_name", "loss_name")
    return metrics.select(name.alias("run_name"), "model_key", "bal_name", "aug_name", "loss_name",
                          F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                          mp.alias("metrics"), "extra")


def write_runs(records: DataFrame, path: str) -> str:
    """S5 (file side): one JSON record per run, under ``run_name=<name>/``; a run
    of the same name is replaced, others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").json(path)
    return path


def append_scored(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append scored rows; the files carry their own schema, so no header
    bookkeeping is needed (CSV gets a header per file)."""
    w = df.write.mode("append")
    if fmt == "csv":
        w = _csv_options(w)
    w.format(fmt).save(path)
    return path
