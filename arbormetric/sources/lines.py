"""Text files with a dense line position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, line, row_id)``; ``row_id`` ``(path, block, place)`` is ordered by path and place in
    the file, however Spark deals the files to tasks."""
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    place = F.monotonically_increasing_id()
    return spark.read.text(paths).select(
        path.alias("path"),
        F.col("value").alias("line"),
        F.struct(path.alias("path"), block.alias("block"), place.alias("place")).alias("row_id"),
    )


def dense_positions(df: DataFrame, row_id: str, name: str) -> DataFrame:
    """Turn the row ids of all lines into 0-based positions; only one count per split is ordered."""
    split = [F.col(row_id)["path"].alias("_path"), F.col(row_id)["block"].alias("_block")]
    counts = df.groupBy(*split).agg(
        F.count("*").alias("_n"), F.min(F.col(row_id)["place"]).alias("_first")
    )
    before = W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        df.withColumns({"_path": split[0], "_block": split[1]})
        .join(starts, ["_path", "_block"])
        .withColumn(name, F.col("_start") + F.col(row_id)["place"] - F.col("_first"))
        .drop("_path", "_block", "_start", "_first", row_id)
    )
