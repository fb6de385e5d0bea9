"""Session builder with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "webassay", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with AQE on and the time zone pinned, as every oracle comparison assumes."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("WEBASSAY_DRIVER_MEMORY", "12g"))
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint(df):
    """Cut lineage through the shared checkpoint folder of the cluster.

    The folder named in ``spark.checkpoint.dir`` is used as it stands. Only
    where none is set and all tasks run in this machine's driver (tests, local
    runs) a local folder is chosen.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/webassay-checkpoints")
    return df.checkpoint()


def forget(*done) -> None:
    """Delete the files of checkpoints that nothing will read again; what is no checkpoint is left alone."""
    for df in done:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
