"""Cutting the lineage of loops, and folders for what lands between two steps, where every machine of the cluster can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which spark.checkpoint.dir names. Where it names none, which no cluster should do, a session on one
    machine gets a temporary folder, and any other an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="newsloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
