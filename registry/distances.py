"""Registered queries of the distances that go by level joins, and of tables of relabel costs."""

from __future__ import annotations

from functools import reduce

from arbormetric.operators import distances as D
from arbormetric.operators.pairs import all_pairs
from arbormetric.operators.variants import Variant, all_variants
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from registry.tables import nation_trees, table
from registry.trees import (
    CANON_SQL,
    CONTIGUOUS_SQL,
    DISTINCT_SQL,
    GAP_SQL,
    NATION_SQL,
    NODE_SQL,
    ORDER_SQL,
    REF_SQL,
    order_structures,
    path_sql,
    structure_query,
)

WEIGHT = 0.5
LEVELED = [v for v in all_variants(WEIGHT) if v.target in (
    "fftf50", "fftt", "tftf50", "tftt", "sttf50", "sttt", "attf50", "attt")]
# Pairs within this distance, without the full matrix.
NEAR = [Variant("s", True, False, 1.0), Variant("t", False, True), Variant("p", False, True)]
NEAR_LIMIT = 2
# Trees of both sources have a root, its children and theirs.
HEIGHT = 2

# Every pair of nodes of two trees, with heights, places among siblings and the gain of a match.
NODE_PAIR_SQL = """heights AS MATERIALIZED (
  SELECT x.tree_id, x.pre, max(y.depth) - x.depth AS h
  FROM nodes x JOIN nodes y ON x.tree_id = y.tree_id AND y.pre >= x.pre AND y.pre < x.pre + x.size
  GROUP BY x.tree_id, x.pre, x.depth),
full_nodes AS MATERIALIZED (SELECT * FROM nodes JOIN heights USING (tree_id, pre)),
sizes AS MATERIALIZED (
  SELECT tree_id, count(*) AS size, list(size ORDER BY pre) AS z FROM nodes GROUP BY 1),
tree_pairs AS (
  SELECT x.tree_id AS i, y.tree_id AS j, x.size + y.size AS total
  FROM sizes x JOIN sizes y ON x.tree_id < y.tree_id),
np AS MATERIALIZED (
  SELECT x.tree_id AS i, y.tree_id AS j, x.pre AS u, y.pre AS v, x.parent AS pu, y.parent AS pv,
         x.ord AS ou, y.ord AS ov, x.h AS hu, y.h AS hv,
         CASE WHEN x.label = y.label THEN 2.0::DOUBLE ELSE {miss} END AS g
  FROM full_nodes x JOIN full_nodes y ON x.tree_id < y.tree_id {costs})"""
COST_JOIN = """LEFT JOIN costs c
    ON c.label_a = least(x.label, y.label) AND c.label_b = greatest(x.label, y.label)"""
# Children matched in order: every chain of child pairs that moves right on both sides.
CHAIN_SQL = """pos{n} AS MATERIALIZED (
  SELECT n.i, n.j, n.pu, n.pv, n.ou, n.ov, m.t FROM np n JOIN memo{before} m USING (i, j, u, v)
  WHERE m.t > 0 AND n.pu IS NOT NULL AND n.pv IS NOT NULL),
chain{n}(i, j, pu, pv, ou, ov, s) AS (
  SELECT i, j, pu, pv, ou, ov, t FROM pos{n}
  UNION ALL
  SELECT c.i, c.j, c.pu, c.pv, p.ou, p.ov, c.s + p.t FROM chain{n} c JOIN pos{n} p
    ON c.i = p.i AND c.j = p.j AND c.pu = p.pu AND c.pv = p.pv AND p.ou > c.ou AND p.ov > c.ov),
best{n} AS MATERIALIZED (
  SELECT i, j, pu AS u, pv AS v, max(s) AS s FROM chain{n} GROUP BY 1, 2, 3, 4)"""
DOWN_SQL = """down{n} AS MATERIALIZED (
  SELECT i, j, u, v, max(down_t) AS down_t, max(down_x) AS down_x, max(across_t) AS across_t,
         max(across_y) AS across_y FROM (
    SELECT n.i, n.j, n.pu AS u, n.v, m.t AS down_t, m.x AS down_x, NULL AS across_t, NULL AS across_y
    FROM np n JOIN memo{before} m USING (i, j, u, v)
    UNION ALL
    SELECT n.i, n.j, n.u, n.pv, NULL, NULL, m.t, m.y
    FROM np n JOIN memo{before} m USING (i, j, u, v)) GROUP BY 1, 2, 3, 4)"""
PIECE_SQL = """grid AS MATERIALIZED (
  SELECT np.i, np.j, np.u, list(greatest(coalesce(t, 0), 0) ORDER BY np.v) AS r
  FROM np LEFT JOIN memo USING (i, j, u, v) GROUP BY 1, 2, 3),
walk(i, j, p, rows) AS (
  SELECT i, j, x.size, [list_transform(range(0, y.size + 1), lambda q: 0.0::DOUBLE)]
  FROM tree_pairs JOIN sizes x ON x.tree_id = i JOIN sizes y ON y.tree_id = j
  UNION ALL
  SELECT i, j, p, list_append(rows, list_transform(range(0, len(z) + 1), lambda q: list_max(base[q + 1:])))
  FROM (
    SELECT i, j, p, rows, z, list_append(list_transform(range(0, len(z)), lambda q:
        greatest(later[q + 1], r[q + 1] + behind[q + z[q + 1] + 1])), 0.0::DOUBLE) AS base
    FROM (
      SELECT w.i, w.j, w.p - 1 AS p, w.rows, w.rows[len(w.rows)] AS later, y.z, g.r,
             w.rows[x.size - (w.p - 1) - x.z[w.p] + 1] AS behind
      FROM walk w JOIN sizes x ON x.tree_id = w.i JOIN sizes y ON y.tree_id = w.j
      JOIN grid g ON g.i = w.i AND g.j = w.j AND g.u = w.p - 1)))"""


def _memo_sql(shape: str) -> str:
    """Gains of all node pairs, level by level; as ``operators.levels`` explains them."""
    connected = shape in ("f", "t")
    level = "least(hu, hv)" if connected else "hu + hv"
    parts = []
    for n in range((1 if connected else 2) * HEIGHT + 1):
        if n:
            parts.append(CHAIN_SQL.format(n=n, before=n - 1))
            parts.append(DOWN_SQL.format(n=n, before=n - 1))
            source = f"np LEFT JOIN best{n} USING (i, j, u, v) LEFT JOIN down{n} USING (i, j, u, v)"
        else:
            source = """np, (SELECT 0.0::DOUBLE AS s, NULL::DOUBLE AS down_t, NULL::DOUBLE AS down_x,
                NULL::DOUBLE AS across_t, NULL::DOUBLE AS across_y)"""
        chain = "(CASE WHEN hu > 0 AND hv > 0 THEN coalesce(s, 0) ELSE 0 END)"
        if shape == "s":
            inner = f"greatest({chain}, down_x, across_y)"
            x, y = f"greatest(0, across_t, {inner})", f"greatest(0, down_t, {inner})"
            t = f"greatest(g + {inner}, {x}, {y})"
        else:
            x = y = "0.0"
            t = f"greatest(g + {chain}, down_t, across_t)" if shape == "a" else f"g + {chain}"
        parts.append(f"""at{n} AS MATERIALIZED (
  SELECT i, j, u, v, {t} AS t, {x} AS x, {y} AS y FROM {source} WHERE {level} = {n}
  {'AND g IS NOT NULL' if connected else ''})""")
        older = f"SELECT * FROM memo{n - 1} UNION ALL " if n else ""
        parts.append(f"memo{n} AS MATERIALIZED ({older}SELECT * FROM at{n})")
    parts.append(f"memo AS (SELECT * FROM memo{n})")
    return ",\n".join(parts)


def level_sql(variant: Variant, source: str, nodes: str, costs: str = "") -> str:
    """``target, i, j, d`` of one variant over the trees of ``nodes``."""
    miss = f"{2 - variant.weight!r}::DOUBLE"
    if variant.exact:
        miss = "NULL"
    elif costs:
        miss = f"2.0::DOUBLE - coalesce(c.cost, {variant.weight!r})"
    use = costs and not variant.exact
    parts = [source, *([costs] if use else []), NODE_SQL.format(src=nodes),
             NODE_PAIR_SQL.format(miss=miss, costs=COST_JOIN if use else ""), _memo_sql(variant.shape)]
    if variant.shape == "f":
        parts.append(PIECE_SQL)
        gain = "SELECT i, j, rows[len(rows)][1] AS g FROM walk WHERE p = 0"
    elif variant.shape == "t":
        gain = "SELECT i, j, greatest(max(t), 0) AS g FROM memo GROUP BY 1, 2"
    else:
        gain = "SELECT i, j, t AS g FROM memo WHERE u = 0 AND v = 0"
    none = "NULL" if variant.shape == "a" else "0"
    return "WITH RECURSIVE " + ",\n".join(parts) + f""",
gains AS ({gain})
SELECT '{variant.target}' AS target, i, j, coalesce(round(total - coalesce(g, {none}), 9), 1e8::DOUBLE) AS d
FROM tree_pairs LEFT JOIN gains USING (i, j)"""


def cost_path_sql(variant: Variant, source: str, nodes: str, costs: str) -> str:
    """The same for a path variant with a table of costs."""
    pairs = f"""sizes AS (SELECT tree_id, count(*) AS size FROM nodes GROUP BY 1),
tree_pairs AS (
  SELECT x.tree_id AS i, y.tree_id AS j, x.size + y.size AS total
  FROM sizes x JOIN sizes y ON x.tree_id < y.tree_id),
node_pairs AS MATERIALIZED (
  SELECT x.tree_id AS i, y.tree_id AS j, x.pre AS u, y.pre AS v, x.parent AS pu, y.parent AS pv,
         x.size AS su, y.size AS sv, x.label = y.label AS same,
         2.0::DOUBLE - coalesce(c.cost, {variant.weight!r}) AS miss
  FROM nodes x JOIN nodes y ON x.tree_id < y.tree_id {COST_JOIN})"""
    body = (GAP_SQL if variant.gap else CONTIGUOUS_SQL).format(miss="miss", keep=1)
    return "WITH RECURSIVE " + ",\n".join([source, costs, NODE_SQL.format(src=nodes), pairs, body]) + f"""
SELECT '{variant.target}' AS target, p.i, p.j, round(p.total - coalesce(b.g, 0), 9) AS d
FROM tree_pairs p LEFT JOIN best b ON p.i = b.i AND p.j = b.j"""


def label_costs(spark, sf_dir) -> DataFrame:
    """Costs of relabelling: market segments by how unlike they are in size, priorities by how far
    they are apart.  A few pairs stand in the other order."""
    customers = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    customers = customers.filter("c_mktsegment is not null")
    a, b = customers.toDF("i", "a"), customers.toDF("j", "b")
    unlike = F.round(10.0 * F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b")), 6)
    segments = (
        all_pairs(customers.select("c_mktsegment"), "c_mktsegment").join(a, "i").join(b, "j")
        .select(F.col("j").alias("label_a"), F.col("i").alias("label_b"), unlike.alias("cost"))
    )
    urgent = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("p")).distinct()
    steps = all_pairs(urgent, "p").select(
        F.col("i").alias("label_a"), F.col("j").alias("label_b"),
        (F.abs(F.col("i").cast("int") - F.col("j").cast("int")) / 4.0).alias("cost"),
    )
    return segments.unionByName(steps)


COST_SQL = """segment_sizes AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1),
urgent AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS p FROM orders),
costs AS MATERIALIZED (
  SELECT x.s AS label_a, y.s AS label_b,
         round(10.0::DOUBLE * abs(x.n - y.n) / (x.n + y.n), 6) AS cost
  FROM segment_sizes x JOIN segment_sizes y ON x.s < y.s
  UNION ALL
  SELECT x.p, y.p, abs(CAST(x.p AS INTEGER) - CAST(y.p AS INTEGER)) / 4.0::DOUBLE
  FROM urgent x JOIN urgent y ON x.p < y.p)"""
COST_LEVELS = [Variant("f", False, False, WEIGHT), Variant("t", False, False, WEIGHT),
               Variant("s", True, False, WEIGHT), Variant("a", True, False, WEIGHT), Variant("a", True, True)]
COST_PATHS = [Variant("p", True, False, WEIGHT), Variant("p", False, False, WEIGHT)]


def _nations(variants, costs=None):
    def query(spark, sf_dir):
        given = costs(spark, sf_dir) if costs else None
        return D.tree_distances(nation_trees(spark, sf_dir), variants=variants, costs=given)

    return query


def _union(texts) -> str:
    return reduce(lambda a, b: f"{a} UNION ALL {b}", [f"(SELECT * FROM ({t}))" for t in texts])


def queries() -> dict:
    result = {
        "level_distances_nations": _nations(LEVELED),
        "cost_distances_levels": _nations(COST_LEVELS, label_costs),
        "cost_distances_paths": _nations(COST_PATHS, label_costs),
    }
    for v in NEAR:
        result[f"near_structures_{v.target}"] = lambda s, d, v=v: D.structure_distances(
            order_structures(s, d), [v], max_distance=NEAR_LIMIT
        )
    for v in all_variants(WEIGHT):
        if v.shape != "p":
            result[f"distance_{v.target}"] = structure_query(v)
    return result


def oracle_sql() -> dict:
    orders = ",\n".join([ORDER_SQL, CANON_SQL, REF_SQL, DISTINCT_SQL])
    result = {
        "level_distances_nations": _union(level_sql(v, NATION_SQL, "trees") for v in LEVELED),
        "cost_distances_levels": _union(level_sql(v, NATION_SQL, "trees", COST_SQL) for v in COST_LEVELS),
        "cost_distances_paths": _union(cost_path_sql(v, NATION_SQL, "trees", COST_SQL) for v in COST_PATHS),
    }
    for v in NEAR:
        whole = path_sql(v, orders) if v.shape == "p" else level_sql(v, orders, "distinct_trees")
        result[f"near_structures_{v.target}"] = f"SELECT * FROM ({whole}) WHERE d <= {NEAR_LIMIT}"
    for v in LEVELED:
        result[f"distance_{v.target}"] = level_sql(v, orders, "distinct_trees")
    return result
