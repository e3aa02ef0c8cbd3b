"""Tree files: one ``class:tree`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.functions.treetext import tree_check, tree_tokens
from arbormetric.sources.lines import dense_positions, read_lines

LINE = r"^([^:]*):(.*)$"


def read_trees(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(tree_id, class, tree, ok, roots)``; the id is the position of the line.

    Only the part behind the first colon is the tree; the class does not leak into the root label.
    """
    lines = dense_positions(read_lines(spark, paths), "row_id", "tree_id")
    check = tree_check(tree_tokens(F.regexp_extract("line", LINE, 2)))
    return lines.select(
        "tree_id",
        F.regexp_extract("line", LINE, 1).alias("class"),
        F.regexp_extract("line", LINE, 2).alias("tree"),
        "line",
        check.alias("check"),
    ).select(
        "tree_id",
        "class",
        "tree",
        (F.col("line").rlike(LINE) & F.col("check.ok")).alias("ok"),
        F.col("check.roots").alias("roots"),
    )


def accepted_trees(trees: DataFrame, strict: bool = False) -> DataFrame:
    """Well-formed trees; strict mode also drops texts with more than one root."""
    return trees.filter(_accepted(strict)).select("tree_id", "class", "tree")


def rejected_trees(trees: DataFrame, strict: bool = False) -> DataFrame:
    return trees.filter(~_accepted(strict)).select("tree_id", "class", "tree")


def _accepted(strict: bool):
    return (F.col("ok") & (F.col("roots") == 1)) if strict else F.col("ok")
