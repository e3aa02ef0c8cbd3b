"""Pairs of trees that can be within a distance: a size band and a prefix filter over labels.

A mapping of trees x and y that pairs m nodes leaves |x| + |y| - 2m single ones at 1 each, and every
pair of unlike labels costs ``weight``.  With c labels in common, counted as often as they stand in
both, at most c pairs are free, so

    d >= | |x| - |y| |   and   d >= |x| + |y| - 2c - max(0, 2 - weight) * (min(|x|, |y|) - c)

for every shape.  The second bound asks for a number of common labels; two trees that have them
share one among the rarest labels of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbormetric.operators.pairs import BUDGET, all_pairs
from arbormetric.operators.variants import Variant
from arbormetric.runtime import cut_lineage


def least_weight(variants: list[Variant], costs: DataFrame | None = None) -> float:
    """The least that a pair of unlike labels costs; exact variants pay as much as for two nodes."""
    weights = [2.0 if v.exact else min(v.weight, 2.0) for v in variants]
    if costs is not None and not all(v.exact for v in variants):
        least = costs.filter("label_a <> label_b").agg(F.min("cost")).first()[0]
        weights.append(2.0 if least is None else min(float(least), 2.0))
    return min(weights)


def label_tokens(arrays: DataFrame, key: str) -> DataFrame:
    """``(key, size, tokens)``: a tree's labels with their counts up to there (``a/1``, ``a/2``), the
    ones that the fewest trees have first."""
    counted = arrays.select(key, "size", F.explode("labels").alias("_label")).groupBy(key, "size", "_label").agg(
        F.count("*").alias("_n")
    )
    own = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_at")
    tokens = counted.select(key, "size", "_label", own).select(
        key, "size", F.concat("_label", F.lit("/"), F.col("_at").cast("string")).alias("token")
    )
    trees = tokens.groupBy("token").agg(F.count("*").alias("trees"))
    ordered = F.array_sort(F.collect_list(F.struct("trees", "token")))
    return tokens.join(trees, "token").groupBy(key, "size").agg(ordered.alias("_own")).select(
        key, "size", F.col("_own.token").alias("tokens")
    )


def _asked(sx: Column, sy: Column, limit: float, weight: float) -> Column:
    """Common labels that a pair of these sizes needs, times the weight; none if not positive."""
    return sx + sy - limit - (2.0 - weight) * F.least(sx, sy)


def candidate_pairs(
    arrays: DataFrame, key: str, limit: float, weight: float, budget: int = BUDGET
) -> DataFrame:
    """``(i, j)`` with i < j: every pair of ``(key, size, labels)`` that can be within ``limit``.

    Pairs that need common labels meet at the first token their prefixes share, in bands of
    sizes; only trees so small that a pair needs none are paired with each other whatever their
    labels.
    """
    if weight == 0:
        # Labels tell nothing: sizes alone.
        sizes = arrays.select(key, "size")
        pairs = all_pairs(arrays.select(key), key, budget)
        both = pairs.join(sizes.toDF("i", "si"), "i").join(sizes.toDF("j", "sj"), "j")
        return both.filter(F.abs(F.col("si") - F.col("sj")) <= limit).select("i", "j")
    trees = cut_lineage(label_tokens(arrays, key))
    spare = limit / min(weight, 1.0)
    # A prefix of the tokens that may be missing and one more.
    prefix = F.slice("tokens", F.lit(1), F.least(F.col("size"), F.lit(int(spare) + 1)))
    band = F.floor(F.col("size") / (int(limit) + 1))
    rows = trees.withColumns({"prefix": prefix, "band": band})
    left = rows.select(
        F.col(key).alias("i"), F.col("size").alias("si"), F.col("tokens").alias("ti"),
        F.col("prefix").alias("pi"), "band", F.explode("prefix").alias("token"),
    )
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    right = rows.select(
        F.col(key).alias("j"), F.col("size").alias("sj"), F.col("tokens").alias("tj"),
        F.col("prefix").alias("pj"), near, "tokens",
    ).drop("tokens").withColumn("token", F.explode("pj"))
    asked = _asked(F.col("si"), F.col("sj"), limit, weight)
    common = F.size(F.array_intersect("ti", "tj"))
    # Of the tokens that both prefixes hold only the first one makes the pair.
    met = (
        left.join(right, ["token", "band"])
        .filter("i < j")
        .filter((F.abs(F.col("si") - F.col("sj")) <= limit) & (asked > 0))
        .filter(F.get(F.array_intersect("pi", "pj"), F.lit(0)) == F.col("token"))
        .filter(common * weight >= asked - 1e-9)
        .select("i", "j")
    )
    tiny = cut_lineage(trees.filter(F.col("size") <= spare).select(key, "size"))
    sizes = tiny.select(key, "size")
    free = (
        all_pairs(tiny.select(key), key, budget)
        .join(sizes.toDF("i", "si"), "i").join(sizes.toDF("j", "sj"), "j")
        .filter((asked <= 0) & (F.abs(F.col("si") - F.col("sj")) <= limit))
        .select("i", "j")
    )
    return met.unionByName(free)
