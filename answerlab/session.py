"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "answerlab") -> SparkSession:
    """Return the active session, or build one tuned for these operators.

    On a cluster the session already exists (spark-submit) and is returned as
    is; the settings below only apply when we create the session ourselves
    (tests, bench, local runs).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # dimension tables here are a handful of rows; keep the automatic
        # broadcast limit at Spark's default, explicit hints carry the rest
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # building plans from Python: skip per-call call-site capture
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.driver.memory", os.environ.get("ANSWERLAB_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and resumable state.

    Uses ``spark.checkpoint.dir`` as configured by the cluster. Only when it
    is unset in a local session (tests) a folder below the session's table storage
    (``spark.sql.warehouse.dir``) is used; on a cluster that is an error, since
    executors would not see each other's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/answerlab-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_table(spark: SparkSession, rows, names):
    """A small parameter table built from literals inside the JVM (a local
    relation); unlike ``createDataFrame`` on Python rows it needs no Python
    worker when it is scanned."""
    from pyspark.sql import functions as F
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def ship_package(spark: SparkSession) -> None:
    """Make ``answerlab`` importable in Python workers (as ``--py-files``
    would): zip the package once per context and add it to the SparkContext,
    which distributes it to every executor."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_answerlab_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="answerlab-pyfiles-")
    zpath = shutil.make_archive(os.path.join(out, "answerlab"), "zip", root_dir=os.path.dirname(pkg_dir),
                                base_dir="answerlab")
    sc.addPyFile(zpath)
    sc._answerlab_shipped = True
