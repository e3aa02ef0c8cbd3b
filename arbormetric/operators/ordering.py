"""Ranks over long columns without one task per group.

``Window.partitionBy(group).orderBy(value)`` puts a whole group into one task.  Here equal values
are counted first, the distinct values of a group are cut into ranges at approximate quantiles,
and each range is ranked by itself and shifted by the counts of the ranges before it.  Equal
values always share a range, so the ranks are exact whatever the quantile error is.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbormetric.runtime import cut_lineage

# Distinct values of a group that one task ranks, in about.
ROWS = 100_000


def cumulative_counts(
    counts: DataFrame, keys: list[str], value: str, n: str, rows: int = ROWS
) -> DataFrame:
    """Add ``n_before``: the sum of ``n`` over smaller ``value`` within ``keys``.

    ``counts`` has one row per (keys, value).  The largest group's rows tell how many ranges of
    about ``rows`` are needed; where every group fits one, no cuts are made.
    """
    counts = cut_lineage(counts)
    most = counts.groupBy(*keys).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0]
    ranges = ceil((most or 0) / rows)
    if ranges <= 1:
        before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumn("n_before", F.coalesce(F.sum(n).over(before), F.lit(0)))
    cuts = counts.groupBy(*keys).agg(
        F.array_distinct(
            F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, ranges * 20))
        ).alias("_cuts")
    )
    placed = (
        counts.join(cuts, keys)
        .withColumn("_range", F.size(F.filter("_cuts", lambda cut: cut < F.col(value))))
        .drop("_cuts")
    )
    totals = placed.groupBy(*keys, "_range").agg(F.sum(n).alias("_total"))
    by_range = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *keys, "_range", F.coalesce(F.sum("_total").over(by_range), F.lit(0)).alias("_shift")
    )
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.join(shifts, [*keys, "_range"])
        .withColumn(
            "n_before", F.col("_shift") + F.coalesce(F.sum(n).over(inside), F.lit(0))
        )
        .drop("_range", "_shift")
    )


def positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add a 0-based ``position`` by a unique ``value`` within ``keys``."""
    ranked = cumulative_counts(df.withColumn("_one", F.lit(1)), keys, value, "_one")
    return ranked.withColumnRenamed("n_before", "position").drop("_one")
