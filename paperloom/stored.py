"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is named and one machine does all (tests)."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: a lost executor costs no recomputation, and all who read it see one state."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
