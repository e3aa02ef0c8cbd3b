"""All-pairs tree distances as jobs over distinct structures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from arbormetric.functions.mapping_kernel import Side, tile_distances
from arbormetric.functions.treetext import tree_reference
from arbormetric.operators.bounded import candidate_pairs, least_weight
from arbormetric.operators.levels import has_levels, level_distances
from arbormetric.operators.nodes import canonical_trees, tree_arrays, tree_nodes
from arbormetric.operators.pairs import BUDGET, pair_tiles
from arbormetric.operators.paths import path_distances
from arbormetric.operators.variants import Variant
from arbormetric.runtime import cut_lineage


def edit_distances(
    arrays: DataFrame, key: str, variants: list[Variant], budget: int = BUDGET
) -> DataFrame:
    """``(target, i, j, d)`` with i < j for shapes f and t with gaps.

    A task gets one tile: two blocks of about ``budget`` nodes each, however many trees there are.
    """
    key_type = arrays.schema[key].dataType
    schema = StructType(
        [
            StructField("target", StringType()),
            StructField("i", key_type),
            StructField("j", key_type),
            StructField("d", DoubleType()),
        ]
    )

    def evaluate(tile: pd.DataFrame) -> pd.DataFrame:
        first = tile[tile["block"] == tile["bi"]]
        second = tile[tile["block"] == tile["bj"]]
        if first.empty or second.empty:
            return pd.DataFrame(columns=schema.names)
        codes: dict = {}
        a = Side(zip(first["labels"], first["sizes"]), codes)
        same = tile["bi"].iloc[0] == tile["bj"].iloc[0]
        b = a if same else Side(zip(second["labels"], second["sizes"]), codes)
        x, y = first[key].to_numpy(), second[key].to_numpy()
        left, right = np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij")
        keep = x[left] < y[right] if same else np.full(left.shape, True)
        i, j = x[left[keep]], y[right[keep]]
        swap = i > j
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        parts = []
        for v in variants:
            d = np.round(tile_distances(a, b, v.shape, v.exact, v.weight)[keep], 9)
            parts.append(pd.DataFrame({"target": v.target, "i": i, "j": j, "d": d}))
        return pd.concat(parts, ignore_index=True)

    tiles = pair_tiles(arrays, key, budget, "size")
    return tiles.groupBy("bi", "bj").applyInPandas(evaluate, schema)


def edit_distances_of(
    pairs: DataFrame, arrays: DataFrame, key: str, variants: list[Variant]
) -> DataFrame:
    """The same for the pairs ``(i, j)`` alone, one after the other."""
    key_type = arrays.schema[key].dataType.simpleString()
    left = arrays.select(F.col(key).alias("i"), F.struct("labels", "sizes").alias("x"))
    right = arrays.select(F.col(key).alias("j"), F.struct("labels", "sizes").alias("y"))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, j, x, y in batch.itertuples(index=False):
                codes: dict = {}
                a = Side([(x["labels"], x["sizes"])], codes)
                b = Side([(y["labels"], y["sizes"])], codes)
                for v in variants:
                    d = tile_distances(a, b, v.shape, v.exact, v.weight)[0, 0]
                    rows.append((v.target, i, j, round(float(d), 9)))
            yield pd.DataFrame(rows, columns=["target", "i", "j", "d"])

    met = pairs.join(left, "i").join(right, "j").select("i", "j", "x", "y")
    return met.mapInPandas(evaluate, f"target string, i {key_type}, j {key_type}, d double")


def structure_distances(
    distinct: DataFrame, variants: list[Variant], budget: int = BUDGET, key: str = "ref",
    costs: DataFrame | None = None, max_distance: float | None = None,
) -> DataFrame:
    """``(target, i, j, d)`` over distinct structures ``(key, tree)``; with ``max_distance`` only the
    pairs that are as near, found without the others' distances.

    The structures are written once; whatever they come from is read once.  ``costs``
    ``(label_a, label_b, cost)`` replaces the weight of the pairs of labels it has (either order);
    shapes f and t with gaps do not take one.
    """
    paths = [v for v in variants if v.shape == "p"]
    levels = [v for v in variants if has_levels(v)]
    edits = [v for v in variants if v not in paths and v not in levels]
    if costs is not None and not all(v.exact for v in edits):
        raise ValueError("shapes f and t with gaps take a weight, not a table of costs")
    arrays = cut_lineage(tree_arrays(tree_nodes(distinct.select(key, "tree"), key), key))
    pairs = None
    if max_distance is not None:
        weight = least_weight(variants, costs)
        pairs = cut_lineage(candidate_pairs(arrays, key, max_distance, weight, budget))
    parts = []
    if edits and pairs is None:
        parts.append(edit_distances(arrays, key, edits, budget))
    elif edits:
        parts.append(edit_distances_of(pairs, arrays, key, edits))
    if levels:
        parts.append(level_distances(arrays, key, levels, budget, costs, pairs=pairs))
    if paths:
        parts.append(path_distances(arrays, key, paths, budget, costs, pairs))
    result = reduce(DataFrame.unionByName, parts)
    return result if max_distance is None else result.filter(F.col("d") <= max_distance)


def self_distances(distinct: DataFrame, variants: list[Variant], key: str = "ref") -> DataFrame:
    """``(target, ref, d)`` of two different trees with equal structure.

    Zero for every shape but paths, which keep only the nodes of one longest path.
    """
    nodes = tree_nodes(distinct.select(key, "tree"), key)
    away = nodes.groupBy(key).agg((2.0 * (F.count("*") - F.max("depth") - 1)).alias("_away"))
    flags = F.array(
        *[
            F.struct(F.lit(v.target).alias("target"), F.lit(v.shape == "p").alias("path"))
            for v in variants
        ]
    )
    return away.select(key, "_away", F.explode(flags).alias("_v")).select(
        F.col("_v.target").alias("target"),
        F.col(key).alias("ref"),
        F.when(F.col("_v.path"), F.col("_away")).otherwise(0.0).alias("d"),
    )


def tree_distances(
    trees: DataFrame,
    shape: str = "f",
    gap: bool = True,
    exact: bool = False,
    weight: float = 1.0,
    budget: int = BUDGET,
    variants: list[Variant] | None = None,
    costs: DataFrame | None = None,
) -> DataFrame:
    """``(target, i, j, d)`` with i < j for all pairs of ``(tree_id, tree)``.

    Equal trees are evaluated once; ids come back by two joins.  The output has one row per pair
    of trees, so for many trees with few structures use ``structure_distances`` and counts.
    """
    variants = variants or [Variant(shape, gap, exact, weight)]
    named = cut_lineage(
        canonical_trees(trees).select(
            "tree_id", tree_reference(F.col("tree")).alias("ref"), "tree"
        )
    )
    distinct = named.select("ref", "tree").distinct()
    between = structure_distances(distinct, variants, budget, costs=costs)
    within = self_distances(distinct, variants).select(
        "target", F.col("ref").alias("i"), F.col("ref").alias("j"), "d"
    )
    owners = named.select("tree_id", "ref")
    left = owners.select(F.col("ref").alias("i"), F.col("tree_id").alias("x"))
    right = owners.select(F.col("ref").alias("j"), F.col("tree_id").alias("y"))
    spread = between.unionByName(within).join(left, "i").join(right, "j")
    return spread.filter("i <> j or x < y").select(
        "target", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "d"
    )
