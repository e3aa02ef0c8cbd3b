"""Path distances (shape p) without Python.

Only the labels on the way from a root to a leaf matter, so trees are reduced to their distinct
root-to-leaf label paths and pairs of paths are scored instead of pairs of nodes:

    d(x, y) = |x| + |y| - max over paths p of x, q of y of gain(p, q)

with a gain of 2 - cost per aligned pair: a weighted common subsequence when gaps are allowed, a
weighted common substring when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbormetric.operators.levels import relabel_costs
from arbormetric.operators.pairs import BUDGET, pair_tiles
from arbormetric.operators.variants import Variant
from arbormetric.runtime import cut_lineage


def node_paths(arrays: DataFrame, key: str) -> DataFrame:
    """``(key, size, path, leaf)``: the distinct label paths from the root to the nodes of a tree.

    One row is read per tree; the ancestors of a node are the earlier nodes whose span holds it.
    """
    nodes = F.transform(
        F.col("sizes"),
        lambda s, at: F.struct(at.alias("at"), s.alias("size"), F.get("labels", at).alias("label")),
    )

    def way(node: Column) -> Column:
        above = F.filter(
            nodes,
            lambda up: (up["at"] <= node["at"]) & (up["at"] + up["size"] > node["at"]),
        )
        return F.struct(
            F.transform(above, lambda up: up["label"]).alias("path"),
            (node["size"] == 1).alias("leaf"),
        )

    ways = F.array_distinct(F.transform(nodes, way))
    return arrays.select(key, "size", F.explode(ways).alias("way")).select(
        key, "size", "way.path", "way.leaf"
    )


def path_id(path: Column) -> Column:
    """Labels hold no blanks, so the joined text is one to one."""
    return F.md5(F.array_join(path, " "))


def _gain(p: Column, q: Column, variant: Variant, relabel: Column | None = None) -> Column:
    """Best total gain of aligning two label paths, as a fold of one row over the labels of p.
    ``relabel`` maps pairs of labels, joined by a blank, to the costs that replace the weight."""
    mismatch = F.lit(0.0 if variant.exact else 2.0 - variant.weight)
    forbidden = variant.exact
    zero = F.transform(q, lambda b: F.lit(0.0))

    def pair_gain(a: Column, b: Column) -> Column:
        other = mismatch
        if relabel is not None:
            cost = F.try_element_at(relabel, F.concat(a, F.lit(" "), b))
            other = F.coalesce(2.0 - cost, mismatch)
        return F.when(a == b, F.lit(2.0)).otherwise(other)

    def before(row: Column, at: Column) -> Column:
        return F.when(at > 0, F.get(row, at - 1)).otherwise(F.lit(0.0))

    if not variant.gap:

        def extend(state: Column, a: Column) -> Column:
            row = F.transform(
                q,
                lambda b, at: (
                    F.when(a == b, before(state["row"], at) + 2.0).otherwise(0.0)
                    if forbidden
                    else F.greatest(pair_gain(a, b) + before(state["row"], at), F.lit(0.0))
                ),
            )
            return F.struct(
                row.alias("row"), F.greatest(state["best"], F.array_max(row)).alias("best")
            )

        start = F.struct(zero.alias("row"), F.lit(0.0).alias("best"))
        return F.aggregate(p, start, extend, lambda state: state["best"])

    def extend_with_gaps(row: Column, a: Column) -> Column:
        diagonal = F.transform(
            q,
            lambda b, at: F.greatest(F.get(row, at), before(row, at) + pair_gain(a, b))
            if not forbidden
            else F.greatest(
                F.get(row, at), F.when(a == b, before(row, at) + 2.0).otherwise(F.lit(0.0))
            ),
        )
        return F.transform(
            diagonal, lambda v, at: F.array_max(F.slice(diagonal, F.lit(1), at + 1))
        )

    return F.coalesce(F.array_max(F.aggregate(p, zero, extend_with_gaps)), F.lit(0.0))


def path_distances(
    arrays: DataFrame, key: str, variants: list[Variant], budget: int = BUDGET,
    costs: DataFrame | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """``(target, i, j, d)`` with i < j for the trees of ``(key, size, labels, sizes)``, or only for
    ``pairs`` ``(i, j)`` of them; then only the paths of such pairs are scored.

    ``costs`` ``(label_a, label_b, cost)`` replaces the weight of the pairs of labels it has.
    """
    ways = node_paths(arrays, key).filter("leaf").select(
        key, "size", "path", path_id(F.col("path")).alias("pid")
    )
    distinct = ways.select("pid", "path").distinct()
    if costs is not None:
        distinct = _with_costs(distinct, costs)
    if pairs is None:
        scored = _path_pairs(distinct, budget)
    else:
        pairs = cut_lineage(pairs.select("i", "j"))
        scored = _paths_of(pairs, ways.select(key, "pid"), distinct)
    relabel = F.col("relabel") if costs is not None else None
    gains = F.array(
        *[
            F.struct(
                F.lit(v.target).alias("target"),
                _gain(F.col("p"), F.col("q"), v, None if v.exact else relabel).alias("g"),
            )
            for v in variants
        ]
    )
    scored = scored.select("pid", "qid", F.explode(gains).alias("gain"))
    # A gain is the same in both orders, so a pair is scored once.
    one = F.struct("pid", "qid")
    other = F.struct(F.col("qid").alias("pid"), F.col("pid").alias("qid"))
    orders = F.when(F.col("pid") == F.col("qid"), F.array(one)).otherwise(F.array(one, other))
    gains = scored.select(F.explode(orders).alias("of"), "gain").select(
        "of.pid", "of.qid", "gain.target", "gain.g"
    )
    # First the best way of each tree against each path, then against each tree.
    left = ways.select(F.col(key).alias("i"), F.col("size").alias("si"), "pid")
    right = ways.select(F.col(key).alias("j"), F.col("size").alias("sj"), F.col("pid").alias("qid"))
    half = gains.join(left, "pid").groupBy("target", "i", "si", "qid").agg(F.max("g").alias("g"))
    met = half.join(right, "qid").filter("i < j")
    if pairs is not None:
        met = met.join(pairs, ["i", "j"], "left_semi")
    return (
        met.groupBy("target", "i", "j", "si", "sj")
        .agg(F.max("g").alias("g"))
        .select(
            "target", "i", "j", F.round(F.col("si") + F.col("sj") - F.col("g"), 9).alias("d")
        )
    )


def _paths_of(pairs: DataFrame, ways: DataFrame, distinct: DataFrame) -> DataFrame:
    """The unordered pairs of paths ``(pid, p, qid, q)`` of the pairs of trees."""
    met = pairs.join(ways.toDF("i", "x"), "i").join(ways.toDF("j", "y"), "j")
    met = met.select(F.least("x", "y").alias("pid"), F.greatest("x", "y").alias("qid")).distinct()
    more = [c for c in distinct.columns if c not in ("pid", "path")]
    left = distinct.select("pid", F.col("path").alias("p"), *more)
    right = distinct.select(F.col("pid").alias("qid"), F.col("path").alias("q"))
    return met.join(left, "pid").join(right, "qid")


def _with_costs(distinct: DataFrame, costs: DataFrame) -> DataFrame:
    """Paths with the costs of relabelling their own labels, a map by pair of labels."""
    half = relabel_costs(costs).toDF("a", "b", "cost")
    table = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    labels = distinct.select("pid", F.explode(F.array_distinct("path")).alias("a"))
    entry = F.struct(F.concat("a", F.lit(" "), "b"), "cost")
    own = labels.join(table, "a").groupBy("pid").agg(F.map_from_entries(F.collect_list(entry)).alias("relabel"))
    return distinct.join(own, "pid", "left")


def _path_pairs(distinct: DataFrame, budget: int) -> DataFrame:
    """Every unordered pair of paths ``(pid, p, qid, q)`` once, by tile; further columns are p's."""
    tiles = pair_tiles(distinct, "pid", budget)
    more = [c for c in distinct.columns if c not in ("pid", "path")]
    left = tiles.filter("block = bi").select("bi", "bj", "pid", F.col("path").alias("p"), *more)
    right = tiles.filter("block = bj").select(
        "bi", "bj", F.col("pid").alias("qid"), F.col("path").alias("q")
    )
    pairs = left.join(right, ["bi", "bj"]).filter("bi < bj or pid <= qid")
    return pairs.select("pid", "p", "qid", "q", *more)


def label_trie(arrays: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Node classes ``(node, above, label)`` by label path from the root, and their members.

    Nodes with the same label path are one class for every path question; ``members`` maps trees
    to the classes they hold.
    """
    paths = node_paths(arrays, key)
    upper = F.slice("path", F.lit(1), F.size("path") - 1)
    classes = paths.select(
        path_id(F.col("path")).alias("node"),
        F.when(F.size("path") > 1, path_id(upper)).alias("above"),
        F.element_at("path", -1).alias("label"),
    ).distinct()
    return classes, paths.select(key, path_id(F.col("path")).alias("node")).distinct()


def extend_node_pairs(frontier: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched pairs ``(u, v)`` whose parents are a pair of ``frontier``: one step down a path."""
    parents = frontier.select(F.col("u").alias("above_u"), F.col("v").alias("above_v"))
    return matched.join(parents, ["above_u", "above_v"], "left_semi")


def common_path_levels(arrays: DataFrame, key: str) -> DataFrame:
    """``(u, v, length)``: node classes that end a common contiguous label path of that length.

    A loop of equi-joins, one per path length, that stops at the first empty level; it starts
    from pairs of classes with equal labels.
    """
    classes = cut_lineage(label_trie(arrays, key)[0])
    left = classes.select(F.col("node").alias("u"), F.col("above").alias("above_u"), "label")
    right = classes.select(F.col("node").alias("v"), F.col("above").alias("above_v"), "label")
    matched = cut_lineage(left.join(right, "label").drop("label"))
    level, length = matched, 1
    levels = []
    while not level.isEmpty():
        levels.append(level.select("u", "v", F.lit(length).alias("length")))
        level = cut_lineage(extend_node_pairs(level, matched))
        length += 1
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    return result.groupBy("u", "v").agg(F.max("length").alias("length"))


def common_path_lengths(arrays: DataFrame, key: str) -> DataFrame:
    """``(i, j, length)``: longest common contiguous downward label path of tree pairs, i < j."""
    arrays = cut_lineage(arrays)
    _, members = label_trie(arrays, key)
    ends = common_path_levels(arrays, key)
    half = (
        ends.join(members.select(F.col(key).alias("i"), F.col("node").alias("u")), "u")
        .groupBy("i", "v")
        .agg(F.max("length").alias("length"))
    )
    return (
        half.join(members.select(F.col(key).alias("j"), F.col("node").alias("v")), "v")
        .filter("i < j")
        .groupBy("i", "j")
        .agg(F.max("length").alias("length"))
    )
