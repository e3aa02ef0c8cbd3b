"""Class tables and the agreement of clusterings with classes.

Assignments are ``(target, k, id, cluster)``, classes ``(id, class)`` or ``(id, class, n)`` when an
id stands for n items of a class.  All measures come from one contingency table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("n"))


def class_index(classes: DataFrame) -> DataFrame:
    """``(class, class_ix)``: position of the class by its first id."""
    # One row per class after the aggregation.
    first = classes.groupBy("class").agg(F.min("id").alias("first_id"))
    return first.select("class", (F.dense_rank().over(W.orderBy("first_id")) - 1).alias("class_ix"))


def encode_classes(classes: DataFrame) -> DataFrame:
    return classes.join(class_index(classes), "class")


def _entropy(n: Column) -> Column:
    total = F.sum(n)
    return F.log(total) - F.sum(n * F.log(n)) / total


def entropy(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """``(by, entropy)``: natural-log entropy of the joint value of ``columns``."""
    counts = df.groupBy(*by, *columns).agg(F.count("*").cast("double").alias("_n"))
    return counts.groupBy(*by).agg(_entropy(F.col("_n")).alias("entropy"))


def contingency(assigned: DataFrame, classes: DataFrame) -> DataFrame:
    """``(target, k, cluster, class, n)``.

    The clusters of an id over all (target, k) are few; the classes side is joined once on id.
    Without ``n`` a repeated row of ``classes`` counts once; an item without a class raises.
    """
    if "n" not in classes.columns:
        classes = classes.select("id", "class").distinct().withColumn("n", F.lit(1))
    missing = F.raise_error(F.lit("an item has no class")).cast(classes.schema["class"].dataType)
    joined = assigned.join(classes.select("id", "class", "n", F.lit(True).alias("_known")), "id", "left")
    joined = joined.withColumn("class", F.when(F.col("_known").isNull(), missing).otherwise(F.col("class")))
    return joined.groupBy("target", "k", "cluster", "class").agg(F.sum("n").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """``(target, k, ari, nmi)``: adjusted Rand index and normalised mutual information."""
    keys = ["target", "k"]
    both = F.col("n") * (F.col("n") - 1) / 2
    n = F.col("n").cast("double")

    def margin(by: list[str], pairs: str, h: str) -> DataFrame:
        grouped = cells.groupBy(*keys, *by).agg(F.sum("n").alias("n"))
        return grouped.groupBy(*keys).agg(F.sum(both).alias(pairs), _entropy(n).alias(h))

    inner = cells.groupBy(*keys).agg(
        F.sum(both).alias("together"), _entropy(n).alias("h"), F.sum("n").alias("items")
    )
    table = inner.join(margin(["cluster"], "p", "hx"), keys).join(
        margin(["class"], "q", "hc"), keys
    )
    p, q, items = F.col("p"), F.col("q"), F.col("items")
    chance = F.try_divide(p * q, items * (items - 1) / 2)
    return table.select(
        *keys,
        F.try_divide(F.col("together") - chance, (p + q) / 2 - chance).alias("ari"),
        (2 - F.try_divide(2 * F.col("h"), F.col("hc") + F.col("hx"))).alias("nmi"),
    )


def adjusted_rand(assigned: DataFrame, classes: DataFrame) -> DataFrame:
    return agreement(contingency(assigned, classes)).select("target", "k", "ari")


def normalized_mutual_info(assigned: DataFrame, classes: DataFrame) -> DataFrame:
    return agreement(contingency(assigned, classes)).select("target", "k", "nmi")


def best_per_target(scores: DataFrame) -> DataFrame:
    """Best value of each measure over k."""
    return scores.groupBy("target").agg(
        F.max("ari").alias("best_ari"), F.max("nmi").alias("best_nmi")
    )


def measures_as_scores(scores: DataFrame) -> DataFrame:
    """``(method, dataset, score)``: every target scored on (measure, k), for the method tests."""
    long = F.explode(
        F.array(
            F.struct(F.lit("ari").alias("measure"), F.col("ari").alias("score")),
            F.struct(F.lit("nmi").alias("measure"), F.col("nmi").alias("score")),
        )
    )
    return scores.select("target", "k", long.alias("m")).select(
        F.col("target").alias("method"),
        F.concat("m.measure", F.lit("@"), F.col("k").cast("string")).alias("dataset"),
        F.col("m.score").alias("score"),
    )


def pivot_by_k(scores: DataFrame, measure: str, k_max: int) -> DataFrame:
    """One row per target, one column per k, values to two decimals."""
    return (
        scores.groupBy("target")
        .pivot("k", list(range(2, k_max + 1)))
        .agg(F.round(F.first(measure), 2))
    )
