"""Tables and folders that several steps of a job share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder of spark.checkpoint.dir, so that neither a second
    reader nor a lost executor computes it again; df itself where no folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  Only a local session may go without such a folder."""
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into columns in the shared folder: compressed, unlike settled(), for
    tables that are as large as the input or read many times.  What was shuffled on the way is
    deleted when it is written."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
