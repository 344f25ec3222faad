"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and the master is local, a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there; no ``localCheckpoint``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Deletes the files of cuts that nothing reads any more, because a later cut holds what was made of them."""
    for df in frames:
        plan = df._jdf.queryExecution().logical() if df is not None else None
        if plan is None or plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(df: DataFrame) -> None:
    """Deletes the shuffle files that an action on ``df`` has left, on all executors.

    Spark itself removes them only when the driver's JVM finds their plans unreachable, which may be much later. Their map
    outputs stay registered, so a plan that should be run again makes them again. Without adaptive execution they are left to Spark.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        shuffles = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
        for shuffle in list(plan.context().shuffleIds().keySet()):
            shuffles.removeShuffle(shuffle, True)


def moved(df: DataFrame) -> DataFrame:
    """``cut`` for rows that nothing else asks ``df`` for: the shuffle files that made them go at once."""
    out = cut(df)
    drop_shuffles(df)
    return out
