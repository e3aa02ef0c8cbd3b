"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arbormetric.llm.tables import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``id, root`` for each id in ``links(a, b)``; the root is the smallest id of the component.

    Every round hangs each id on its smallest neighbour, if that is smaller than itself, follows the
    trees that this makes up to their tops by pointer jumping, and goes on with the links between
    different tops. So a link is only read again as long as its ends are apart. Rows of a
    frequent neighbour are spread by Spark's skew join, and minima are combined before the shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, roots = stored(both.filter("a <> b").distinct()), None
    while roots is None or edges.limit(1).count():
        tops = _tops(stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))))
        if roots is None:
            merged = tops
        else:
            # Ids whose component is complete have no links any more.
            over = tops.toDF("root", "top")
            merged = stored(roots.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
            discard(roots)
        ends = tops.toDF("a", "top_a"), tops.toDF("b", "top_b")
        apart = edges.join(ends[0], "a").join(ends[1], "b").filter("top_a <> top_b")
        rest = stored(apart.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct())
        discard(edges)
        if roots is not None:
            discard(tops)
        edges, roots = rest, merged
    discard(edges)
    return roots


def _tops(parents: DataFrame) -> DataFrame:
    """``id, root`` with the top of each id's tree for ``parents(id, root)``, where tops are their own."""
    while True:
        above = parents.select(F.col("id").alias("root"), F.col("root").alias("up"))
        jumped = stored(parents.join(above, "root").select("id", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
        discard(parents)
        parents = jumped.select("id", "root")
        if not jumped.filter("moved").limit(1).count():
            return parents


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` of the components that ``links`` make of those of ``roots``, of which only links between
    different ones are looked at."""
    known = [roots.toDF(c, f"root_{c}") for c in "ab"]
    between = links.join(known[0], "a", "left").join(known[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = connected_components(between)
    over = more.toDF("root", "top")
    moved = roots.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    # Ids that had no link before.
    return stored(moved.union(more.join(roots.select("id"), "id", "left_anti")))
