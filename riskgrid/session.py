"""Session helpers: builder defaults and the checkpoint folder."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "riskgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # checkpoint files go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a session that runs in one process (as in tests) gets a temporary folder; on a cluster that
    folder would be another one on each machine, so there the setting is demanded.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="riskgrid-checkpoint-")
    context.setCheckpointDir(named)


#: Whether Spark deletes the shuffle files of an action when it ends, instead of when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives the loss of executors. The shuffle files it took go at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, as other actions of ``df`` may need its files
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def release(*stored: DataFrame) -> None:
    """Delete the rows of frames from ``cut_lineage`` that nothing will read again."""
    for df in stored:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_finished(spark: SparkSession) -> None:
    """Have Spark delete the shuffle and checkpoint files of plans that nothing refers to any more.

    Spark does so when the driver's heap is collected, which may come long after the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def fixed_rows(df: DataFrame) -> DataFrame:
    """Evaluate a frame of a few fitted rows now and carry it on as constants.

    Only for results whose size does not grow with the data (one row of limits).
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def sized_side(df: DataFrame, max_bytes: int = 32_000_000) -> DataFrame:
    """Materialise a join side and measure it; hint a broadcast only up to ``max_bytes`` (of its rows as JSON text).

    Beyond the limit the side stays a plain frame, joined by shuffle with
    adaptive skew handling.
    """
    done = cut_lineage(df)
    size = done.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(done) if size <= max_bytes else done
