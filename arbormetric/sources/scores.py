"""Score files: ``method,score,score,...`` per line, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.sources.lines import read_lines


def read_scores(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """``(method, dataset, score)``; the data set is the place in the line.

    The last line of a repeated method counts; strict mode raises instead.
    """
    fields = read_lines(spark, paths).select(F.split("line", ",").alias("f"), "row_id")
    kept = fields.groupBy(F.col("f")[0].alias("method")).agg(
        F.max_by("f", "row_id").alias("f"), F.count("*").alias("n")
    )
    if strict:
        kept = kept.filter(
            F.when(F.col("n") == 1, True).otherwise(
                F.raise_error(F.lit("a method is repeated")).cast("boolean")
            )
        )
    values = F.slice("f", F.lit(2), F.size("f"))
    return kept.select("method", F.posexplode(values).alias("place", "score")).select(
        "method", F.format_string("%09d", "place").alias("dataset"), F.col("score").cast("double")
    )


def write_result(result: dict[str, DataFrame], path: str) -> None:
    """Clusterings, scores and best values of a comparison, one folder per target in each."""
    for name in ("assigned", "scores", "best"):
        result[name].write.partitionBy("target").parquet(f"{path}/{name}")
