"""Trees as node tables.

``tree_nodes`` deals the trees out once, to as many tasks as their texts ask for; depth, parent, size and
sibling order are windows over the tokens of that one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbormetric.functions.treetext import (
    canonical_tree,
    tree_check,
    tree_reference,
    tree_tokens,
)
from arbormetric.runtime import cut_lineage

#: Characters of tree texts, and so tokens at most, that one task is dealt.
TASK_CHARS = 250_000


def canonical_trees(trees: DataFrame) -> DataFrame:
    """Replace ``tree`` by the canonical text of its first root; malformed rows are dropped."""
    tokens = trees.withColumn("_tokens", tree_tokens(F.col("tree"))).withColumn(
        "_check", tree_check(F.col("_tokens"))
    )
    return (
        tokens.filter("_check.ok")
        .withColumn(
            "tree", canonical_tree(F.slice("_tokens", F.lit(1), F.col("_check.first")))
        )
        .drop("_tokens", "_check")
    )


def tree_ref(trees: DataFrame) -> DataFrame:
    """``(tree_id, ref)``: equal structures share a digest."""
    return canonical_trees(trees).select("tree_id", tree_reference(F.col("tree")).alias("ref"))


def structures(trees: DataFrame) -> DataFrame:
    """Distinct structures ``(ref, tree, n)`` with the number of trees that have them.

    Equal texts are counted first, so each is parsed once.
    """
    return (
        canonical_trees(trees.groupBy("tree").agg(F.count("*").alias("n")))
        .groupBy("tree")
        .agg(F.sum("n").alias("n"))
        .select(tree_reference(F.col("tree")).alias("ref"), "tree", "n")
    )


def _dealt_out(trees: DataFrame, key: str) -> DataFrame:
    """``(key, tree)`` hashed by key to tasks of about ``TASK_CHARS`` characters each, so that what a window
    sorts does not grow with the number of trees; an exchange below deals rows out before they
    become tokens."""
    texts = cut_lineage(trees.select(key, "tree"))
    chars = texts.agg(F.sum(F.length("tree"))).first()[0] or 0
    return texts.repartition(1 + chars // TASK_CHARS, key)


def token_depths(trees: DataFrame, key: str = "tree_id") -> DataFrame:
    """``(key, pos, token, depth, labels)``: the parser stack as running sums over the tokens."""
    in_order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    tokens = _dealt_out(trees, key).select(key, F.posexplode(tree_tokens(F.col("tree"))).alias("pos", "token"))
    return tokens.select(
        key,
        "pos",
        "token",
        F.sum(opens.cast("int") - closes.cast("int")).over(in_order).cast("int").alias("depth"),
        F.sum((~(opens | closes)).cast("int")).over(in_order).cast("int").alias("labels"),
    )


def tree_nodes(trees: DataFrame, key: str = "tree_id") -> DataFrame:
    """``(key, pre, parent, depth, ord, label, size)``, one row per node in pre-order.

    At one depth the tokens alternate in a fixed way: an opening bracket of the parent, labels,
    and after each inner label its own closing bracket.
    """
    level = W.partitionBy(key, "depth").orderBy("pos")
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    opened = F.last(F.when(opens, F.col("labels") - 1), ignorenulls=True)
    after = F.lead(F.struct(closes.alias("closes"), F.col("labels"))).over(level)
    siblings = W.partitionBy(key, "parent").orderBy("pre")
    return (
        token_depths(trees, key)
        .withColumn("parent", opened.over(level.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_after", after)
        .filter(~(opens | closes))
        .select(
            key,
            (F.col("labels") - 1).alias("pre"),
            "parent",
            "depth",
            F.col("token").alias("label"),
            F.when(F.col("_after.closes"), F.col("_after.labels") - F.col("labels") + 1)
            .otherwise(1)
            .alias("size"),
        )
        .withColumn("ord", (F.row_number().over(siblings) - 1).cast("int"))
    )


def subtree_sizes(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    return nodes.select(key, "pre", "label", "size")


def tree_arrays(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """A tree as a value: ``(key, size, labels, sizes)`` in pre-order."""
    ordered = F.array_sort(F.collect_list(F.struct("pre", "label", "size")))
    return (
        nodes.groupBy(key)
        .agg(ordered.alias("_nodes"))
        .select(
            key,
            F.size("_nodes").alias("size"),
            F.col("_nodes.label").alias("labels"),
            F.col("_nodes.size").alias("sizes"),
        )
    )
