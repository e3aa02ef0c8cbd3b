"""Distances to clustering quality, for all targets in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbormetric.functions.treetext import tree_reference
from arbormetric.operators.clustering import cut, hac
from arbormetric.operators.distances import self_distances, structure_distances
from arbormetric.operators.evaluation import agreement, best_per_target, contingency, pivot_by_k
from arbormetric.operators.nodes import canonical_trees
from arbormetric.operators.variants import Variant
from arbormetric.runtime import cut_lineage


def compare_targets(
    dist: DataFrame,
    classes: DataFrame,
    link: str = "complete",
    k_max: int = 20,
    weights: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Cluster every target, cut at k = 2..k_max and score each cut against the classes, of which
    there have to be two at least."""
    if classes.select("class").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two classes")
    merges = hac(dist, link, weights)
    merges = cut_lineage(merges)
    assigned = cut(merges, k_max)
    scores = cut_lineage(agreement(contingency(assigned, classes)))
    return {
        "merges": merges,
        "assigned": assigned,
        "scores": scores,
        "best": best_per_target(scores),
        "ari_by_k": pivot_by_k(scores, "ari", k_max),
        "nmi_by_k": pivot_by_k(scores, "nmi", k_max),
    }


def compare_tree_distances(
    trees: DataFrame, variants: list[Variant], link: str = "complete", k_max: int = 20
) -> dict[str, DataFrame]:
    """Trees ``(tree_id, class, tree)`` to clustering quality of every distance variant.

    Trees are counted by structure and class first.  Everything quadratic runs over distinct
    structures, which stand for their trees by weight; the trees themselves are read once.
    Under path shapes equal trees are apart from each other unless they are paths, so a structure
    cannot stand for several of them there: that raises, and ``compare_targets`` over
    ``tree_distances`` is the way for such trees.
    """
    texts = trees.groupBy("tree", "class").agg(F.count("*").alias("n"))  # Few: parsed after this.
    counted = cut_lineage(
        canonical_trees(texts)
        .groupBy("tree", "class")
        .agg(F.sum("n").alias("n"))
        .select(tree_reference(F.col("tree")).alias("id"), "tree", "class", "n")
    )
    distinct = counted.groupBy("id", "tree").agg(F.sum("n").alias("n"))
    paths = [v for v in variants if v.shape == "p"]
    if paths:
        apart = self_distances(distinct.filter("n > 1"), paths, "id").filter("d > 0")
        if apart.limit(1).count():
            raise ValueError("equal trees are apart under path shapes: cluster the trees themselves")
    dist = structure_distances(distinct.withColumnRenamed("id", "ref"), variants)
    return compare_targets(
        dist, counted.select("id", "class", "n"), link, k_max, distinct.select("id", "n")
    )
