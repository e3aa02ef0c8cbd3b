"""Tree distances by level joins (shapes f and t without gaps, s and a).

Everything runs over distinct subtrees.  A table of gains is built bottom up: the gain of a pair of
subtrees is what an alignment saves against removing both, so

    d(u, v) = |u| + |v| - gain(u, v)

and it follows from the gains of pairs that hold a child of u, a child of v or both.  A level takes
the pairs whose heights allow it, joins them with the gains of their child pairs and folds each
pair's ordered children in one row.  No task sees more than the children of one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbormetric.operators.pairs import BUDGET, all_pairs
from arbormetric.operators.variants import NO_AGREEMENT, Variant
from arbormetric.runtime import cut_lineage, GrowingTable

CONNECTED, SEPARATED, AGREEMENT = "connected", "s", "a"


def has_levels(variant: Variant) -> bool:
    return variant.shape in ("s", "a") or (variant.shape in ("f", "t") and not variant.gap)


def _kind(variant: Variant) -> str:
    return variant.shape if variant.shape in ("s", "a") else CONNECTED


def _model(variant: Variant) -> str:
    return "exact" if variant.exact else str(variant.weight)


def tree_subtrees(arrays: DataFrame, key: str) -> DataFrame:
    """``(key, pos, id, label, size, height, kids)`` for each node of ``(key, size, labels, sizes)``.

    ``id`` is a digest of the subtree's pre-order labels and sizes; equal subtrees share it.
    """
    places = F.sequence(F.lit(0), F.col("size") - 1)
    tokens = F.zip_with("labels", "sizes", lambda label, size: F.concat(label, F.lit("/"), size))
    spanned = arrays.select(
        key, "size", "labels", "sizes", places.alias("_places"), tokens.alias("_tokens")
    )

    def identity(at: Column) -> Column:
        own = F.slice("_tokens", at + 1, F.get("sizes", at))
        return F.unhex(F.md5(F.array_join(own, " ")))

    def above(at: Column) -> Column:
        return F.filter("_places", lambda up: (up < at) & (up + F.get("sizes", up) > at))

    spanned = spanned.withColumns(
        {
            "_ids": F.transform("_places", identity),
            "_above": F.transform("_places", above),
        }
    )
    depths = F.transform("_above", F.size)
    spanned = spanned.withColumns(
        {"_depths": depths, "_parents": F.transform("_above", lambda up: F.array_max(up))}
    )

    def node(at: Column) -> Column:
        kids = F.filter("_places", lambda kid: F.get("_parents", kid) == at)
        size = F.get("sizes", at)
        deepest = F.array_max(F.slice("_depths", at + 1, size))
        return F.struct(
            at.alias("pos"),
            F.get("_ids", at).alias("id"),
            F.get("labels", at).alias("label"),
            size.alias("size"),
            (deepest - F.get("_depths", at)).alias("height"),
            F.transform(kids, lambda kid: F.get("_ids", kid)).alias("kids"),
        )

    return spanned.select(key, F.explode(F.transform("_places", node)).alias("_n")).select(
        key, "_n.*"
    )


def relabel_costs(costs: DataFrame) -> DataFrame:
    """``(label_a, label_b, cost)`` with label_a < label_b; either order in the input counts for both.

    Equal labels cost nothing, whatever the table says.  A pair with two costs raises, as do a
    missing and a negative cost.
    """
    ordered = (
        costs.filter("label_a <> label_b")
        .select(
            F.least("label_a", "label_b").alias("label_a"),
            F.greatest("label_a", "label_b").alias("label_b"),
            F.col("cost").cast("double").alias("cost"),
        )
        .groupBy("label_a", "label_b")
        .agg(F.min("cost").alias("cost"), F.max("cost").alias("_most"), F.count("cost").alias("_n"),
             F.count("*").alias("_rows"))
    )
    wrong = (F.col("cost") != F.col("_most")) | (F.col("_n") != F.col("_rows")) | (F.col("cost") < 0)
    checked = F.when(wrong, F.raise_error(F.lit("a relabel cost is not one number from 0 on")).cast("double"))
    return ordered.select("label_a", "label_b", checked.otherwise(F.col("cost")).alias("cost"))


def subtree_pairs(
    subtrees: DataFrame, models: list[Variant], costs: DataFrame | None, budget: int = BUDGET,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Every unordered pair of distinct subtrees once per cost model, a subtree with itself too, or
    the ``pairs`` ``(i, j)`` of them with i <= j:
    ``(model, u, v, su, sv, hu, hv, ku, kv, gain)``; ``gain`` is that of matching the two roots,
    null where that is forbidden."""
    if pairs is None:
        ids = subtrees.select("id")
        pairs = all_pairs(ids, "id", budget).unionByName(
            ids.select(F.col("id").alias("i"), F.col("id").alias("j"))
        )

    def side(end: str, name: str) -> DataFrame:
        return subtrees.select(
            F.col("id").alias(end), F.col("label").alias(f"l{name}"), F.col("size").alias(f"s{name}"),
            F.col("height").alias(f"h{name}"), F.col("kids").alias(f"k{name}"),
        )

    pairs = pairs.join(side("i", "u"), "i").join(side("j", "v"), "j")
    given = F.lit(None).cast("double")
    if costs is not None:
        table = relabel_costs(costs)
        pairs = pairs.withColumns(
            {"label_a": F.least("lu", "lv"), "label_b": F.greatest("lu", "lv")}
        ).join(table, ["label_a", "label_b"], "left")
        given = F.col("cost")
    other = [
        F.lit(None).cast("double") if v.exact else 2.0 - F.coalesce(given, F.lit(float(v.weight)))
        for v in models
    ]
    per_model = F.array(
        *[
            F.struct(
                F.lit(_model(v)).alias("model"),
                F.when(F.col("lu") == F.col("lv"), F.lit(2.0)).otherwise(gain).alias("gain"),
            )
            for v, gain in zip(models, other)
        ]
    )
    return pairs.select(
        F.col("i").alias("u"), F.col("j").alias("v"), "su", "sv", "hu", "hv", "ku", "kv",
        F.explode(per_model).alias("_m"),
    ).select("_m.model", "u", "v", "su", "sv", "hu", "hv", "ku", "kv", "_m.gain")


def _chain(cells: Column, rows: Column, width: Column) -> Column:
    """Largest sum of cells that go down and to the right, as a fold over the rows of a matrix;
    ``cells`` has its values row by row, null counting as nothing."""

    def extend(best: Column, row: Column) -> Column:
        base = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda at: F.greatest(
                F.get(best, at + 1),
                F.get(best, at) + F.coalesce(F.get(cells, row * width + at), F.lit(0.0)),
            ),
        )
        running = F.transform(base, lambda _, at: F.array_max(F.slice(base, F.lit(1), at + 1)))
        return F.concat(F.array(F.lit(0.0)), running)

    start = F.transform(F.sequence(F.lit(0), width), lambda _: F.lit(0.0))
    return F.element_at(F.aggregate(F.sequence(F.lit(0), rows - 1), start, extend), -1)


def both_orders(gains: DataFrame) -> DataFrame:
    """Gains of ``(u, v)`` and of ``(v, u)``; what belongs to one side changes sides."""
    turned = {"u": "v", "v": "u", "x": "y", "y": "x"}
    swapped = gains.filter("u <> v").select(
        *[F.col(turned.get(c, c)).alias(c) for c in gains.columns]
    )
    return gains.unionByName(swapped)


def _children(level: DataFrame, kind: str) -> DataFrame:
    """``(model, u, v, way, at, p, q)``: the pairs ``(p, q)`` that a pair ``(u, v)`` follows from.
    Way 0: a child of each, ``at`` counting row by row; way 1: a child of u and v; way 2: u and a
    child of v."""
    own = ["model", "u", "v"]
    rows = level.select(*own, "kv", F.posexplode("ku").alias("_i", "p"))
    cells = rows.select(*own, "_i", "p", F.size("kv").alias("_w"), F.posexplode("kv").alias("_j", "q"))
    ways = cells.select(
        *own, F.lit(0).alias("way"), (F.col("_i") * F.col("_w") + F.col("_j")).alias("at"), "p", "q"
    )
    if kind == CONNECTED:
        return ways
    down = rows.select(*own, F.lit(1).alias("way"), F.lit(0).alias("at"), "p", F.col("v").alias("q"))
    across = level.select(
        *own, F.lit(2).alias("way"), F.lit(0).alias("at"), F.col("u").alias("p"), F.explode("kv").alias("q")
    )
    return ways.unionByName(down).unionByName(across)


def subtree_gains(pairs: DataFrame, kind: str) -> DataFrame:
    """``(model, u, v, t, x, y)`` for the pairs of ``subtree_pairs``.

    ``t`` is the gain of the two subtrees.  Connected: with both roots matched.  Agreement: matched
    or descended on one side, null where nothing agrees.  Separated: ``x`` and ``y`` are the gains
    of u with the children of v and of v with the children of u.
    """
    height = F.least("hu", "hv") if kind == CONNECTED else F.col("hu") + F.col("hv")
    if kind == CONNECTED:
        pairs = pairs.filter("gain is not null")
    leveled = cut_lineage(pairs.withColumn("level", height))
    known = GrowingTable(
        leveled.sparkSession,
        leveled.select("model", "u", "v", *[F.lit(0.0).alias(c) for c in "txy"]).schema,
    )
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    for at in range((leveled.agg(F.max("level")).first()[0] or 0) + 1):
        level = leveled.filter(F.col("level") == at)
        if at:
            wanted = _children(level, kind)
            gains = both_orders(known.read()).withColumnsRenamed({"u": "p", "v": "q"})
            found = wanted.join(gains, ["model", "p", "q"], "left")

            def best(way: int, gain: str) -> Column:
                return F.max(F.when(F.col("way") == way, F.col(gain)))

            cell = F.when(F.col("way") == 0, F.struct("at", "t"))
            found = found.groupBy("model", "u", "v").agg(
                F.array_sort(F.collect_list(cell)).alias("cells"),
                best(1, "t").alias("down_t"), best(1, "x").alias("down_x"),
                best(2, "t").alias("across_t"), best(2, "y").alias("across_y"),
            )
            level = level.join(found, ["model", "u", "v"], "left")
            inner = (F.col("hu") > 0) & (F.col("hv") > 0)
            matched = F.transform("cells", lambda c: c["t"])
            chain = F.when(inner, _chain(matched, F.size("ku"), F.size("kv"))).otherwise(zero)
            level = level.withColumn("chain", chain)
        else:
            level = level.withColumns(
                {"chain": zero, "down_t": nothing, "down_x": nothing, "across_t": nothing, "across_y": nothing}
            )
        if kind == SEPARATED:
            level = level.withColumn("_f", F.greatest("chain", "down_x", "across_y"))
            level = level.withColumns(
                {"x": F.greatest(zero, "across_t", "_f"), "y": F.greatest(zero, "down_t", "_f")}
            ).withColumn("t", F.greatest(F.col("gain") + F.col("_f"), "x", "y"))
        else:
            here = F.col("gain") + F.col("chain")
            t = F.greatest(here, "down_t", "across_t") if kind == AGREEMENT else here
            level = level.withColumns({"t": t, "x": zero, "y": zero})
        known.add(level.select("model", "u", "v", "t", "x", "y"))
    return known.read()


def _root_gains(gains: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``(model, i, j, g)`` with i < j: the gains of whole trees."""
    roots = nodes.filter("pos = 0").select(key, "id")
    left = roots.select(F.col(key).alias("i"), F.col("id").alias("u"))
    right = roots.select(F.col(key).alias("j"), F.col("id").alias("v"))
    return (
        both_orders(gains).join(left, "u").join(right, "v").filter("i < j")
        .select("model", "i", "j", F.col("t").alias("g"))
    )


def _best_pairs(gains: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``(model, i, j, g)`` with i < j: the best pair of subtrees anywhere inside, where one gains."""
    members = nodes.select(key, "id").distinct()
    left = members.select(F.col(key).alias("i"), F.col("id").alias("u"))
    right = members.select(F.col(key).alias("j"), F.col("id").alias("v"))
    # First the best of each tree against each subtree, then against each tree.
    half = both_orders(gains.filter("t > 0")).join(left, "u").groupBy("model", "i", "v").agg(F.max("t").alias("t"))
    return (
        half.join(right, "v").filter("i < j").groupBy("model", "i", "j").agg(F.max("t").alias("g"))
    )


def _piece_gains(
    gains: DataFrame, nodes: DataFrame, trees: DataFrame, key: str, wanted: DataFrame
) -> DataFrame:
    """``(model, i, j, g)`` with i < j: the best sequence of matched subtrees, each behind the one
    before it and outside of it on both sides, where one gains.

    A subtree meets a tree as one row, an array over the tree's nodes; a tree's rows are folded from
    its last node to its first.
    """
    right = nodes.select(F.col(key).alias("j"), F.col("id").alias("v"), F.col("pos").alias("q"))
    entry = F.map_from_entries(F.collect_list(F.struct("q", "t")))
    rows = both_orders(gains.filter("t > 0")).join(right, "v").groupBy("model", "u", "j").agg(entry.alias("of"))
    ends = trees.select(F.col(key).alias("j"), F.col("sizes").alias("sj"))
    dense = F.transform("sj", lambda _, q: F.coalesce(F.try_element_at("of", q), F.lit(0.0)))
    rows = rows.join(ends, "j").select("model", "u", "j", dense.alias("row"))
    left = nodes.select(F.col(key).alias("i"), F.col("id").alias("u"), F.col("pos").alias("p"))
    pairs = (
        rows.join(left, "u").filter("i < j").join(wanted, ["i", "j"], "left_semi")
        .groupBy("model", "i", "j").agg(F.collect_list(F.struct("p", "row")).alias("rows"))
        .join(trees.select(F.col(key).alias("i"), F.col("sizes").alias("si")), "i")
        .join(ends, "j")
    )
    n, m = F.size("si"), F.size("sj")
    start = F.array(F.transform(F.sequence(F.lit(0), m), lambda _: F.lit(0.0)))

    def extend(state: Column, p: Column) -> Column:
        own = F.get(F.filter("rows", lambda r: r["p"] == p), F.lit(0))["row"]
        later = F.element_at(state, -1)
        behind = F.get(state, n - p - F.get("si", p))
        base = F.transform(
            later,
            lambda skip, q: F.greatest(
                skip, F.get(own, q) + F.get(behind, q + F.get("sj", q))
            ),
        )
        row = F.transform(base, lambda _, q: F.array_max(F.slice(base, q + 1, m + 1 - q)))
        return F.concat(state, F.array(row))

    backwards = F.reverse(F.sequence(F.lit(0), n - 1))
    folded = F.aggregate(backwards, start, extend, lambda state: F.get(F.element_at(state, -1), F.lit(0)))
    return pairs.select("model", "i", "j", folded.alias("g"))


def level_distances(
    arrays: DataFrame, key: str, variants: list[Variant], budget: int = BUDGET,
    costs: DataFrame | None = None, null_no_agreement: bool = False, pairs: DataFrame | None = None,
) -> DataFrame:
    """``(target, i, j, d)`` with i < j for the trees of ``(key, size, labels, sizes)``, or only for
    ``pairs`` ``(i, j)`` of them; then the table of gains has the pairs of their subtrees alone.

    ``costs`` ``(label_a, label_b, cost)`` replaces the weight of the pairs of labels it has; exact
    variants forbid all of them.  Under exact agreement trees without a common label are at
    NO_AGREEMENT, or null by option.
    """
    nodes = cut_lineage(tree_subtrees(arrays, key))
    subtrees = cut_lineage(nodes.select("id", "label", "size", "height", "kids").dropDuplicates(["id"]))
    trees = arrays.select(key, "size", "sizes")
    within = None
    if pairs is None:
        tree_pairs = cut_lineage(all_pairs(trees.select(key), key, budget))
    else:
        tree_pairs = cut_lineage(pairs.select("i", "j"))
        members = nodes.select(key, "id").distinct()
        met = tree_pairs.join(members.toDF("i", "u"), "i").join(members.toDF("j", "v"), "j")
        within = met.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).distinct()
    wanted_pairs = tree_pairs
    sizes = trees.select(key, "size")
    tree_pairs = tree_pairs.join(sizes.toDF("i", "si"), "i").join(sizes.toDF("j", "sj"), "j")
    parts = []
    for kind in (CONNECTED, SEPARATED, AGREEMENT):
        own = [v for v in variants if has_levels(v) and _kind(v) == kind]
        if not own:
            continue
        models = list({_model(v): v for v in own}.values())
        gains = subtree_gains(subtree_pairs(subtrees, models, costs, budget, within), kind)
        for shape in dict.fromkeys(v.shape for v in own):
            if shape == "f":
                found = _piece_gains(gains, nodes, trees, key, wanted_pairs)
            elif shape == "t":
                found = _best_pairs(gains, nodes, key)
            else:
                found = _root_gains(gains, nodes, key)
            named = F.array(
                *[F.struct(F.lit(v.target).alias("target"), F.lit(_model(v)).alias("model"))
                  for v in own if v.shape == shape]
            )
            wanted = tree_pairs.select("i", "j", "si", "sj", F.explode(named).alias("_v"))
            wanted = wanted.select("_v.target", "_v.model", "i", "j", "si", "sj")
            # Shapes f and t may leave all nodes out; agreement may not.
            least = F.lit(None).cast("double") if shape == "a" else F.lit(0.0)
            d = F.round(F.col("si") + F.col("sj") - F.coalesce("g", least), 9)
            if shape == "a" and not null_no_agreement:
                d = F.coalesce(d, F.lit(NO_AGREEMENT))
            parts.append(
                wanted.join(found, ["model", "i", "j"], "left").select("target", "i", "j", d.alias("d"))
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
