"""The folder that driver and executors share, and rows kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, only a session in one process gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="repetend-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, with its lineage cut: it is worked out once, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(kept: DataFrame) -> None:
    """Delete the files of what checkpointed() gave; nothing may read them again."""
    file = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
