"""Lineage cuts for the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and return a reader of the written table.

    ``DataFrame.checkpoint`` keeps the constraints of the plan it replaces, and those double with
    every round of a loop of joins; a written table starts afresh and also survives the loss of
    executors.
    """
    path = _new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class GrowingTable:
    """A table in the checkpoint folder that rows are added to, one job at a time."""

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema, self.path = spark, schema, _new_folder(spark)
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        """``rows`` may come from an earlier ``read``, which has listed its files."""
        rows.select(self.schema.names).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _new_folder(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark)}/arbormetric-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and
    the session runs on this machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arbormetric-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()
