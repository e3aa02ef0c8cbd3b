"""Score tables ``(method, dataset, score)``: summary, completeness gate and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score_summary(scores: DataFrame) -> DataFrame:
    """Elements per method."""
    return scores.groupBy("method").agg(F.count("*").alias("n_scores"))


def completeness(scores: DataFrame) -> DataFrame:
    """Per method: its number of scores, the number of data sets, and whether they agree."""
    n_datasets = scores.select(F.countDistinct("dataset")).scalar()
    return score_summary(scores).select(
        "method",
        "n_scores",
        n_datasets.alias("n_datasets"),
        ((F.col("n_scores") > 0) & (F.col("n_scores") == n_datasets)).alias("complete"),
    )


def complete_datasets(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Keep the data sets that every method has a score for; in strict mode raise on others."""
    n_methods = scores.select(F.countDistinct("method")).scalar()
    counted = scores.groupBy("dataset").agg(F.count("*").alias("_n"))
    if strict:
        checked = F.when(F.col("_n") == n_methods, F.lit(True)).otherwise(
            F.raise_error(F.lit("methods have different numbers of scores")).cast("boolean")
        )
        return scores.join(counted.filter(checked).drop("_n"), "dataset", "left_semi")
    return scores.join(counted.filter(F.col("_n") == n_methods), "dataset", "left_semi")


def average_rank(scores: DataFrame) -> DataFrame:
    """Rank the methods of each data set, highest score first; ties share their mean rank."""
    by_score = W.partitionBy("dataset").orderBy(F.desc("score"))
    ties = W.partitionBy("dataset", "score")
    return scores.withColumn(
        "rank", F.rank().over(by_score) + (F.count("*").over(ties) - 1) / 2
    )


def mean_rank(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("method").agg(F.avg("rank").alias("mean_rank"))
