"""Tables written once in the folder that driver and executors share, and read back.

For what must not be computed twice, such as paid answers: a written table survives lost
executors, a persisted one is computed again. The folder is that of ``spark.checkpoint.dir``;
only a local master, as in tests, gets one of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="querent-"))
    return spark.sparkContext.getCheckpointDir()


def write(df: DataFrame, name: str) -> str:
    """The folder of a table of its own that df is written to."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table of its own and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))
