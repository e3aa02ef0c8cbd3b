"""All unordered pairs of a table, cut into square tiles.

A row goes to one tile per block, so a tile holds two blocks and a task never sees more.  Blocks
hold rows of similar size and about ``budget`` units of it, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 4000
# Rows of a block where rows have no size: a tile has at most about this many squared pairs.
ROWS = 500


def blocks(items: DataFrame, key: str, budget: int = BUDGET, size: str | None = None) -> DataFrame:
    """Add ``block`` and ``n_blocks``.  Without ``size`` a row weighs 1 and blocks have up to ROWS."""
    if size is None:
        rows = items.select(F.count("*")).scalar()
        n = F.greatest(F.ceil(rows / min(budget, ROWS)), F.lit(1)).cast("long")
        return items.withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64(key), F.col("n_blocks")))
    sized = items.withColumn("_class", F.floor(F.log2(F.col(size))).cast("int"))
    everything = W.orderBy("_class")
    # At most 32 rows: one per power of two.
    classes = (
        sized.groupBy("_class")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_share",
            F.ceil(F.col("_n") * F.pow(F.lit(2.0), F.col("_class") + 1) / budget),
        )
        .select(
            "_class",
            "_share",
            (F.sum("_share").over(everything) - F.col("_share")).alias("_start"),
            F.sum("_share")
            .over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            .alias("n_blocks"),
        )
    )
    return (
        sized.join(F.broadcast(classes), "_class")
        .withColumn("block", F.col("_start") + F.pmod(F.xxhash64(key), F.col("_share")))
        .drop("_class", "_share", "_start")
    )


def pair_tiles(
    items: DataFrame, key: str, budget: int = BUDGET, size: str | None = None
) -> DataFrame:
    """Every row once per tile ``(bi, bj)`` of its block, bi <= bj."""
    return (
        blocks(items, key, budget, size)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .withColumn("bi", F.least("block", "_other"))
        .withColumn("bj", F.greatest("block", "_other"))
        .drop("_other", "n_blocks")
    )


def all_pairs(items: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """``(i, j)`` with i < j for every unordered pair, by an equi-join on the tile."""
    tiles = pair_tiles(items.select(key), key, budget)
    left = tiles.filter("block = bi").select("bi", "bj", F.col(key).alias("x"))
    right = tiles.filter("block = bj").select("bi", "bj", F.col(key).alias("y"))
    ordered = (F.col("bi") < F.col("bj")) | (F.col("x") < F.col("y"))
    return (
        left.join(right, ["bi", "bj"])
        .filter(ordered)
        .select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    )


def symmetric(dist: DataFrame) -> DataFrame:
    """Both orders of every pair and a zero diagonal, per target."""
    dist = dist.select("target", "i", "j", "d")
    orders = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    square = dist.select("target", F.explode(orders).alias("_o"), "d").select(
        "target", "_o.i", "_o.j", "d"
    )
    ids = dist.select("target", F.explode(F.array("i", "j")).alias("i")).distinct()
    return square.unionByName(
        ids.select("target", "i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    )


def lower_triangle(square: DataFrame) -> DataFrame:
    return square.filter("j <= i")
