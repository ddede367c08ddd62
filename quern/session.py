"""Session creation and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quern", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which outlives executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a local session, as in
    tests, uses a temporary folder; a cluster has none that all machines share, and the call fails. Files are removed
    with the data they hold if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true, as ``get_spark`` sets it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has too few splits for them, as a small table in one file; else unchanged.

    For work that costs far more per row than moving the row. Large inputs have splits enough and are never moved; what
    a shuffle has made is left alone, as counting its partitions would run it.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    splits = execution.toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits * 2 <= cores else df
