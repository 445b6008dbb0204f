"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the context reads this when a checkpoint is made: its files go once nothing refers to it
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="faultline-"))


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the folder that all executors share."""
    _ensure_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share; whoever asks for it deletes it."""
    _ensure_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
