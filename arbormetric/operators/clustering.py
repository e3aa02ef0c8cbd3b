"""Hierarchical clustering of distance tables ``(target, i, j, d)`` with i < j.

Merges are ``(target, step, left, right, height, size)``; a cluster is named by its smallest item
and ``right`` joins ``left``.  Equal distances are broken by the smaller, then the larger name.

Targets of at most ``group_limit`` items are clustered one per task, many at a time.  Larger ones
go through rounds of joins and aggregations over the pair table, so no task holds a matrix.  Both
merge in the same order, ties included, so the limit never shows in a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from arbormetric.runtime import cut_lineage

GROUP_LIMIT = 2000
# Decimals in which two distances have to differ: sums in another order differ behind them.
DECIMALS = 9
# Link names; those on squared distances; those whose merges may be done in any order.
LINKS = ("single", "complete", "upgma", "wpgma", "upgmc", "wpgmc", "ward")
SQUARED = ("upgmc", "wpgmc", "ward")
REDUCIBLE = ("single", "complete", "upgma", "wpgma", "ward")


def link_name(name: str) -> str:
    """Any unknown name means complete."""
    return name.lower() if name.lower() in LINKS else "complete"


def hac(
    dist: DataFrame,
    link: str = "complete",
    weights: DataFrame | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Agglomerative clustering of every target.

    ``weights`` ``(id, n)`` makes an item stand for n equal ones at distance 0.
    """
    link = link_name(link)
    dist = cut_lineage(dist.select("target", "i", "j", "d"))
    large = _large(dist, group_limit)
    if large.isEmpty():
        return hac_grouped(dist, link, weights)
    small = dist.join(large, "target", "left_anti")
    return hac_grouped(small, link, weights).unionByName(
        hac_rounds(dist.join(large, "target", "left_semi"), link, weights, group_limit)
    )


def _missing(what: str) -> Column:
    return F.raise_error(F.lit(f"an item has no {what}")).cast("double")


def _large(pairs: DataFrame, group_limit: int) -> DataFrame:
    """Targets with more pairs than ``group_limit`` items have."""
    counts = pairs.groupBy("target").agg(F.count("*").alias("_pairs"))
    return counts.filter(F.col("_pairs") > group_limit * (group_limit - 1) // 2)


def hac_grouped(dist: DataFrame, link: str, weights: DataFrame | None = None) -> DataFrame:
    """One task per target; the matrix of a target must fit a task (see ``hac``)."""
    if weights is None:
        sized = dist.withColumns({"ni": F.lit(1.0), "nj": F.lit(1.0)})
    else:
        keys = ["target"] if "target" in weights.columns else []
        n = weights.select(*keys, "id", F.col("n").cast("double").alias("n"))
        sized = (
            dist.join(n.withColumnsRenamed({"id": "i", "n": "ni"}), [*keys, "i"], "left")
            .join(n.withColumnsRenamed({"id": "j", "n": "nj"}), [*keys, "j"], "left")
            .withColumns({c: F.coalesce(c, _missing("weight")) for c in ("ni", "nj")})
        )
    schema = StructType(
        [
            StructField("target", dist.schema["target"].dataType),
            StructField("step", IntegerType()),
            StructField("left", dist.schema["i"].dataType),
            StructField("right", dist.schema["i"].dataType),
            StructField("height", DoubleType()),
            StructField("size", LongType()),
        ]
    )

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]))
        i, j = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        d = np.full((len(ids), len(ids)), np.inf)
        d[i, j] = d[j, i] = pdf["d"]
        n = np.ones(len(ids))
        n[i], n[j] = pdf["ni"], pdf["nj"]
        merges = pd.DataFrame(
            _merge_all(d, n, link), columns=["step", "left", "right", "height", "size"]
        )
        merges["left"], merges["right"] = ids[merges["left"]], ids[merges["right"]]
        merges.insert(0, "target", pdf["target"].iloc[0])
        return merges

    return sized.groupBy("target").applyInPandas(cluster, schema)


def _merge_all(d: np.ndarray, n: np.ndarray, link: str) -> list[tuple]:
    """Merge the closest clusters until one is left, keeping the nearest later one of each row."""
    if link in SQUARED:
        d = d * d
    items = len(n)
    upper = np.where(np.arange(items)[:, None] < np.arange(items)[None, :], d, np.inf)
    compared = np.round(upper, DECIMALS)
    near = compared.argmin(axis=1)
    close = compared[np.arange(items), near]
    alive = np.ones(items, dtype=bool)
    merges = []
    for step in range(1, items):
        a = int(close.argmin())
        b = int(near[a])
        height = upper[a, b]
        to_a = np.minimum(upper[a], upper[:, a])
        to_b = np.minimum(upper[b], upper[:, b])
        merged = _linked(to_a, to_b, height, n[a], n[b], n, link)
        alive[b] = False
        n[a] += n[b]
        others = alive.copy()
        others[a] = False
        upper[b, :] = upper[:, b] = np.inf
        compared[b, :] = compared[:, b] = np.inf
        close[b] = np.inf
        before, after = others.copy(), others.copy()
        before[a:] = False
        after[: a + 1] = False
        upper[before, a] = merged[before]
        upper[a, after] = merged[after]
        compared[:, a], compared[a] = np.round(upper[:, a], DECIMALS), np.round(upper[a], DECIMALS)
        nearer = before & ((compared[:, a] < close) | ((compared[:, a] == close) & (a < near)))
        close[nearer], near[nearer] = compared[nearer, a], a
        stale = (others & ~nearer & ((near == a) | (near == b))).nonzero()[0]
        for r in [a, *stale.tolist()]:
            near[r] = compared[r].argmin()
            close[r] = compared[r, near[r]]
        shown = np.sqrt(max(height, 0.0)) if link in SQUARED else height
        merges.append((step, a, b, float(shown), int(n[a])))
    return merges


def _linked(x, y, between, nx, ny, nz, link):
    """Distance of every other cluster (size nz) to the union of two clusters."""
    both = nx + ny
    with np.errstate(invalid="ignore"):
        if link == "single":
            return np.minimum(x, y)
        if link == "complete":
            return np.maximum(x, y)
        if link == "upgma":
            return (nx * x + ny * y) / both
        if link == "wpgma":
            return (x + y) / 2
        if link == "upgmc":
            return (nx * x + ny * y) / both - nx * ny * between / (both * both)
        if link == "wpgmc":
            return (x + y) / 2 - between / 4
        return ((nx + nz) * x + (ny + nz) * y - nz * between) / (both + nz)


def hac_rounds(
    dist: DataFrame, link: str, weights: DataFrame | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """The same by rounds over the pair table, until what is left of a target fits a task.

    A round merges the closest pair of each target and, for reducible links, all pairs that are
    each other's only nearest neighbour: no other merge can come between such a pair, whatever the
    order.  The steps are then put in the order of merging one pair at a time.  Distances that tie
    all over take as many rounds as merges.
    """
    link = link_name(link)
    value = F.col("d") * F.col("d") if link in SQUARED else F.col("d")
    pairs = cut_lineage(dist.select("target", "i", "j", value.alias("d")))
    ids = pairs.select("target", F.explode(F.array("i", "j")).alias("id")).distinct()
    if weights is None:
        sizes = ids.withColumn("n", F.lit(1.0))
    else:
        keys = ["target"] if "target" in weights.columns else []
        n = weights.select(*keys, "id", F.coalesce(F.col("n").cast("double"), _missing("weight")).alias("n"))
        sizes = ids.join(n, [*keys, "id"], "left").withColumn("n", F.coalesce("n", _missing("weight")))
    sizes = cut_lineage(sizes.select("target", "id", "n"))
    done, number = [], 0
    while not _large(pairs, group_limit).isEmpty():
        number += 1
        merges = cut_lineage(_round_merges(pairs, sizes, link))
        done.append(
            merges.select(
                "target",
                F.lit(number).alias("round"),
                F.lit(0).alias("step"),
                "left",
                "right",
                (F.sqrt(F.greatest("d", F.lit(0.0))) if link in SQUARED else F.col("d")).alias(
                    "height"
                ),
                (F.col("n_left") + F.col("n_right")).cast("long").alias("size"),
            )
        )
        members = _members(merges, sizes)
        pairs = cut_lineage(_round_pairs(pairs, members, link))
        sizes = cut_lineage(
            members.groupBy("target", F.col("rep").alias("id")).agg(F.max("n_rep").alias("n"))
        )
    rest = pairs
    if link in SQUARED:
        rest = pairs.withColumn("d", F.sqrt(F.greatest("d", F.lit(0.0))))
    last = hac_grouped(rest, link, sizes).withColumn("round", F.lit(number + 1))
    for merges in done:
        last = last.unionByName(merges)
    if link in REDUCIBLE:
        return _in_order(last, dist.schema)
    by_round = W.partitionBy("target").orderBy("round", "step", "left")
    return last.withColumn("step", F.row_number().over(by_round)).drop("round")


def _in_order(merges: DataFrame, pairs: StructType) -> DataFrame:
    """Steps as if one pair was merged at a time: of the merges whose clusters are there the one
    with the least height, then the smaller names.  A task has the merges of a target, one row an
    item."""

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["round", "step", "height", "left"], ignore_index=True)
        made, waits, then = {}, [0] * len(pdf), [[] for _ in range(len(pdf))]
        keys = list(zip(pdf["height"].round(DECIMALS), pdf["left"], pdf["right"]))
        for at, (_, left, right) in enumerate(keys):
            for before in {made[x] for x in (left, right) if x in made}:
                waits[at] += 1
                then[before].append(at)
            made[left] = at
        ready = [(keys[at], at) for at, n in enumerate(waits) if n == 0]
        heapq.heapify(ready)
        steps = np.zeros(len(pdf), dtype=int)
        for step in range(1, len(pdf) + 1):
            _, at = heapq.heappop(ready)
            steps[at] = step
            for later in then[at]:
                waits[later] -= 1
                if waits[later] == 0:
                    heapq.heappush(ready, (keys[later], later))
        return pdf.assign(step=steps)[["target", "step", "left", "right", "height", "size"]]

    schema = StructType(
        [
            StructField("target", pairs["target"].dataType),
            StructField("step", IntegerType()),
            StructField("left", pairs["i"].dataType),
            StructField("right", pairs["i"].dataType),
            StructField("height", DoubleType()),
            StructField("size", LongType()),
        ]
    )
    return merges.groupBy("target").applyInPandas(number, schema)


def _round_merges(pairs: DataFrame, sizes: DataFrame, link: str) -> DataFrame:
    near = F.round("d", DECIMALS)
    edge = F.struct(near.alias("near"), F.col("i").alias("left"), F.col("j").alias("right"), "d")
    chosen = pairs.groupBy("target").agg(F.min(edge).alias("edge"))
    if link in REDUCIBLE:
        ends = pairs.select("target", F.explode(F.array("i", "j")).alias("id"), edge.alias("edge"))
        furthest = F.struct((-F.col("edge.near")).alias("near"), "edge.left", "edge.right")
        nearest = ends.groupBy("target", "id").agg(
            F.min("edge").alias("edge"), F.max(furthest).alias("tied")
        )
        only = nearest.filter("edge.left = tied.left AND edge.right = tied.right")
        mutual = only.groupBy("target", "edge").agg(F.count("*").alias("_n")).filter("_n = 2")
        chosen = chosen.unionByName(mutual.drop("_n")).distinct()
    chosen = chosen.select("target", "edge.left", "edge.right", "edge.d")
    return chosen.join(
        sizes.withColumnsRenamed({"id": "left", "n": "n_left"}), ["target", "left"]
    ).join(sizes.withColumnsRenamed({"id": "right", "n": "n_right"}), ["target", "right"])


def _members(merges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every cluster with the one it belongs to after the round and the distance it spans."""
    both = F.explode(F.array("left", "right")).alias("id")
    moved = merges.select(
        "target",
        both,
        F.col("left").alias("rep"),
        (F.col("n_left") + F.col("n_right")).alias("n_rep"),
        F.col("d").alias("span"),
        (F.col("n_left") * F.col("n_right")).alias("product"),
    )
    return sizes.join(moved, ["target", "id"], "left").select(
        "target",
        "id",
        "n",
        F.coalesce("rep", "id").alias("rep"),
        F.coalesce("n_rep", "n").alias("n_rep"),
        F.coalesce("span", F.lit(0.0)).alias("span"),
        F.coalesce("product", F.lit(0.0)).alias("product"),
    )


def _round_pairs(pairs: DataFrame, members: DataFrame, link: str) -> DataFrame:
    def side(end: str) -> DataFrame:
        named = {c: f"{c}_{end}" for c in ("n", "rep", "n_rep", "span", "product")}
        return members.withColumnsRenamed({"id": end, **named})

    joined = pairs.join(side("i"), ["target", "i"]).join(side("j"), ["target", "j"])
    outer = joined.filter("rep_i <> rep_j")
    turned = F.col("rep_i") > F.col("rep_j")

    def pick(column: str, first: bool) -> Column:
        one, two = F.col(f"{column}_i"), F.col(f"{column}_j")
        return F.when(turned, two if first else one).otherwise(one if first else two)

    columns = {}
    for column in ("rep", "n_rep", "span", "product"):
        columns[f"{column}_a"] = pick(column, True)
        columns[f"{column}_b"] = pick(column, False)
    d, ni, nj = F.col("d"), F.col("n_i"), F.col("n_j")
    na, nb = F.col("n_rep_a"), F.col("n_rep_b")
    spans = F.col("span_a"), F.col("span_b")
    value = {
        "single": F.min(d),
        "complete": F.max(d),
        "upgma": F.sum(ni * nj * d) / F.sum(ni * nj),
        "wpgma": F.avg(d),
        "ward": (F.sum((ni + nj) * d) - F.first(nb * spans[0] + na * spans[1])) / F.first(na + nb),
        "upgmc": F.sum(ni * nj * d) / F.sum(ni * nj)
        - F.first(
            F.col("product_a") * spans[0] / (na * na) + F.col("product_b") * spans[1] / (nb * nb)
        ),
        "wpgmc": F.avg(d) - F.first((spans[0] + spans[1]) / 4),
    }[link]
    return (
        outer.withColumns(columns)
        .groupBy("target", F.col("rep_a").alias("i"), F.col("rep_b").alias("j"))
        .agg(value.alias("d"))
    )


def cut(merges: DataFrame, k_max: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(target, k, id, cluster)`` for k = 2..k_max: the clusters after n-k steps."""
    merges = cut_lineage(merges.select("target", "step", "left", "right"))
    counts = merges.groupBy("target").agg((F.count("*") + 1).alias("_items"))
    large = counts.filter(F.col("_items") > group_limit)
    if large.isEmpty():
        return _cut_grouped(merges, k_max)
    small = merges.join(large, "target", "left_anti")
    big = merges.join(large, "target", "left_semi")
    return _cut_grouped(small, k_max).unionByName(cut_by_jumping(big, k_max))


def _cut_grouped(merges: DataFrame, k_max: int) -> DataFrame:
    item = merges.schema["left"].dataType
    schema = StructType(
        [
            StructField("target", merges.schema["target"].dataType),
            StructField("k", IntegerType()),
            StructField("id", item),
            StructField("cluster", item),
        ]
    )

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        ids = np.unique(np.concatenate([pdf["left"].to_numpy(), pdf["right"].to_numpy()]))
        cluster = np.arange(len(ids))
        left, right = np.searchsorted(ids, pdf["left"]), np.searchsorted(ids, pdf["right"])
        parts = []
        for at, (a, b) in enumerate(zip(left, right)):
            k = len(ids) - at
            if 2 <= k <= k_max:
                parts.append(pd.DataFrame({"k": k, "id": ids, "cluster": ids[cluster]}))
            cluster[cluster == b] = a
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["k", "id", "cluster"])
        out.insert(0, "target", pdf["target"].iloc[0])
        return out

    return merges.groupBy("target").applyInPandas(assign, schema)


def cut_by_jumping(merges: DataFrame, k_max: int) -> DataFrame:
    """The same by pointer doubling: an item follows its merges up to step n-k, for all k at once."""
    steps = merges.groupBy("target").agg(F.count("*").alias("_steps"))
    last = F.col("_steps") + 1 - F.col("k")
    ids = merges.select("target", F.explode(F.array("left", "right")).alias("id")).distinct()
    own = merges.select("target", F.col("right").alias("id"), "left", "step")
    pointers = (
        ids.join(steps, "target")
        .withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(k_max))))
        .filter(last >= 0)
        .join(own, ["target", "id"], "left")
        .select(
            "target",
            "k",
            "id",
            F.when(F.col("step") <= last, F.col("left")).otherwise(F.col("id")).alias("cluster"),
        )
    )
    pointers = cut_lineage(pointers)
    while True:
        onward = pointers.select("target", "k", F.col("id").alias("cluster"),
                                 F.col("cluster").alias("next"))
        moved = cut_lineage(
            pointers.join(onward, ["target", "k", "cluster"]).select(
                "target", "k", "id", F.col("next").alias("cluster"),
                (F.col("next") != F.col("cluster")).alias("_moved"),
            )
        )
        pointers = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return pointers
