"""Registered queries over trees, pairs and distances, with their SQL."""

from __future__ import annotations

from arbormetric.functions.treetext import tree_check, tree_tokens
from arbormetric.operators import distances as D
from arbormetric.operators import nodes as N
from arbormetric.operators import pairs as P
from arbormetric.operators import paths as T
from arbormetric.operators.variants import Variant, all_variants, target_name
from pyspark.sql import functions as F
from registry.tables import nation_trees, order_trees, table

ORDER_SQL = """kinds AS (
  SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem),
flags AS (
  SELECT l_orderkey, l_returnflag,
         l_returnflag || '(' || string_agg(l_linestatus, ', ' ORDER BY l_linestatus) || ')' AS t
  FROM kinds GROUP BY 1, 2),
below AS (
  SELECT l_orderkey, string_agg(t, ' ' ORDER BY l_returnflag) AS t FROM flags GROUP BY 1),
trees AS (
  SELECT o_orderkey AS tree_id, o_orderpriority AS class,
         o_orderstatus || ' (' || t || ')' AS tree
  FROM orders JOIN below ON o_orderkey = l_orderkey)"""
NATION_SQL = """counts AS (
  SELECT c_nationkey, c_mktsegment, substr(o_orderpriority, 1, 1) AS p, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
marked AS (
  SELECT *, sum(n) OVER (PARTITION BY c_nationkey, c_mktsegment) AS total FROM counts),
segments AS (
  SELECT c_nationkey, c_mktsegment, any_value(total) AS total,
         c_mktsegment || '(' || coalesce(
           string_agg(p, ',' ORDER BY n DESC, p), '') || ')' AS t
  FROM marked GROUP BY 1, 2),
trees AS (
  SELECT CAST(c_nationkey AS BIGINT) AS tree_id, any_value(r_name) AS class,
         'N(' || string_agg(t, ',' ORDER BY total DESC, t) || ')' AS tree
  FROM segments JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1)"""
CANON_SQL = """canon AS (
  SELECT tree_id, class, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(tree,
    '\\s*([(),])\\s*', '\\1', 'g'), '()', ''), '[,\\s]+', ',', 'g'), ',?([()]),?', '\\1', 'g'),
    '\\)([^(),])', '),\\1', 'g') AS tree FROM trees)"""
REF_SQL = """refs AS (
  SELECT tree_id, class, tree, to_base64(unhex(md5(
    regexp_replace(tree, '([^(),]+)([,)]|$)', '\\1()\\2', 'g')))) AS ref FROM canon)"""
DISTINCT_SQL = """distinct_trees AS (
  SELECT ref AS tree_id, tree, count(*) AS n FROM refs GROUP BY 1, 2)"""
NODE_SQL = """tokens AS (
  SELECT tree_id, unnest(regexp_extract_all(tree, '[^,\\s()]+|[()]')) AS token,
         generate_subscripts(regexp_extract_all(tree, '[^,\\s()]+|[()]'), 1) AS pos
  FROM {src}),
levels AS (
  SELECT tree_id, pos, token,
         sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth,
         sum(CASE WHEN token IN ('(', ')') THEN 0 ELSE 1 END) OVER w AS labels
  FROM tokens WINDOW w AS (PARTITION BY tree_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
linked AS (
  SELECT *,
         last_value(CASE WHEN token = '(' THEN labels - 1 END IGNORE NULLS) OVER (
           PARTITION BY tree_id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING) AS parent,
         lead(token) OVER w2 AS next_token, lead(labels) OVER w2 AS next_labels
  FROM levels WINDOW w2 AS (PARTITION BY tree_id, depth ORDER BY pos)),
nodes AS (
  SELECT tree_id, CAST(labels - 1 AS INTEGER) AS pre, CAST(parent AS INTEGER) AS parent,
         CAST(depth AS INTEGER) AS depth, token AS label,
         CAST(CASE WHEN next_token = ')' THEN next_labels - labels + 1 ELSE 1 END AS INTEGER)
           AS size,
         CAST(row_number() OVER (PARTITION BY tree_id, parent ORDER BY pos) - 1 AS INTEGER) AS ord
  FROM linked WHERE token NOT IN ('(', ')'))"""
PAIR_SQL = """sizes AS (SELECT tree_id, count(*) AS size FROM nodes GROUP BY 1),
tree_pairs AS (
  SELECT x.tree_id AS i, y.tree_id AS j, x.size + y.size AS total
  FROM sizes x JOIN sizes y ON x.tree_id < y.tree_id),
node_pairs AS (
  SELECT x.tree_id AS i, y.tree_id AS j, x.pre AS u, y.pre AS v, x.parent AS pu, y.parent AS pv,
         x.size AS su, y.size AS sv, x.label = y.label AS same
  FROM nodes x JOIN nodes y ON x.tree_id < y.tree_id)"""
# Path variants: a path that may run through mismatches, or matched nodes only.
CONTIGUOUS_SQL = """walk(i, j, u, v, e) AS (
  SELECT i, j, u, v, CASE WHEN same THEN 2.0::DOUBLE ELSE {miss} END FROM node_pairs
  WHERE pu IS NULL OR pv IS NULL
  UNION ALL
  SELECT n.i, n.j, n.u, n.v, CASE WHEN n.same THEN 2.0::DOUBLE + greatest(0, w.e)
         ELSE {miss} + {keep} * greatest(0, w.e) END
  FROM walk w JOIN node_pairs n ON n.i = w.i AND n.j = w.j AND n.pu = w.u AND n.pv = w.v),
best AS (SELECT i, j, greatest(0, max(e)) AS g FROM walk GROUP BY 1, 2)"""
GAP_SQL = """chain(i, j, u, v, su, sv, g) AS (
  SELECT i, j, u, v, su, sv, CASE WHEN same THEN 2.0::DOUBLE ELSE {miss} END FROM node_pairs
  WHERE same OR {miss} > 0
  UNION
  SELECT n.i, n.j, n.u, n.v, n.su, n.sv,
         c.g + CASE WHEN n.same THEN 2.0::DOUBLE ELSE {miss} END
  FROM chain c JOIN node_pairs n ON n.i = c.i AND n.j = c.j AND n.u > c.u AND n.u < c.u + c.su
    AND n.v > c.v AND n.v < c.v + c.sv WHERE n.same OR {miss} > 0),
best AS (SELECT i, j, max(g) AS g FROM chain GROUP BY 1, 2)"""
END_SQL = """ SELECT '{target}' AS target, p.i, p.j, round(p.total - coalesce(b.g, 0), 9) AS d
FROM tree_pairs p LEFT JOIN best b ON p.i = b.i AND p.j = b.j"""
PATHS = {
    "pttf": Variant("p", True, False, 0.5),
    "pttt": Variant("p", True, True),
    "pftf": Variant("p", False, False, 0.5),
    "pftt": Variant("p", False, True),
}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def path_sql(variant: Variant, source: str, nodes: str = "distinct_trees") -> str:
    miss = "0.0::DOUBLE" if variant.exact else f"{2 - variant.weight!r}::DOUBLE"
    body = GAP_SQL if variant.gap else CONTIGUOUS_SQL
    return _with(
        source, NODE_SQL.format(src=nodes), PAIR_SQL,
        body.format(miss=miss, keep=0 if variant.exact else 1),
    ) + END_SQL.format(target=variant.target)


def nation_paths(spark, sf_dir):
    return D.tree_distances(nation_trees(spark, sf_dir), variants=[PATHS["pftt"]])


def order_structures(spark, sf_dir):
    return N.structures(order_trees(spark, sf_dir))


def structure_query(*variants: Variant):
    return lambda s, d: D.structure_distances(order_structures(s, d), list(variants))


def nation_query(*variants: Variant):
    return lambda s, d: D.tree_distances(nation_trees(s, d), variants=list(variants))


def order_arrays(spark, sf_dir):
    return N.tree_arrays(N.tree_nodes(order_structures(spark, sf_dir), "ref"), "ref")


def checked_texts(spark, sf_dir):
    """Bracket texts made from whole documents, most of them malformed on purpose."""
    text = F.regexp_replace("text", r"[\s,]+", ",")
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), text.alias("tree"))


def text_check(spark, sf_dir):
    check = tree_check(tree_tokens(F.col("tree")))
    return checked_texts(spark, sf_dir).select("doc_id", check.alias("c")).select(
        "doc_id", F.col("c.roots").alias("roots")
    )


def target_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flag = F.when(F.col("p_partkey") % 2 == 0, "t").otherwise("f")
    weight = F.col("p_size") / F.lit(100.0)
    return part.select(
        "p_partkey",
        target_name(F.lit("f"), flag, F.lit("t"), flag, weight).alias("target"),
        target_name(F.lit("f"), flag, F.lit("t"), flag, weight, legacy=True).alias("legacy"),
    )


def tile_coverage(spark, sf_dir):
    """In how many tiles each pair of structures meets: one, for all pairs."""
    tiles = P.pair_tiles(order_arrays(spark, sf_dir), "ref", 200, "size")
    left = tiles.filter("block = bi").select("bi", "bj", F.col("ref").alias("x"))
    right = tiles.filter("block = bj").select("bi", "bj", F.col("ref").alias("y"))
    ordered = (F.col("bi") < F.col("bj")) | (F.col("x") < F.col("y"))
    met = left.join(right, ["bi", "bj"]).filter(ordered)
    return met.groupBy(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(
        F.count("*").alias("tiles")
    )


def queries() -> dict:
    result = {
        "tree_nodes": lambda s, d: N.tree_nodes(order_trees(s, d)),
        "token_depths": lambda s, d: N.token_depths(order_trees(s, d)),
        "subtree_sizes": lambda s, d: N.subtree_sizes(N.tree_nodes(nation_trees(s, d))),
        "tree_ref": lambda s, d: N.tree_ref(order_trees(s, d)),
        "canonical_trees": lambda s, d: N.canonical_trees(order_trees(s, d)),
        "structures": order_structures,
        "tree_text_roots": text_check,
        "target_names": target_names,
        "tree_pairs": lambda s, d: P.all_pairs(order_structures(s, d), "ref"),
        "pair_tiles": tile_coverage,
        "symmetric_matrix": lambda s, d: P.symmetric(nation_paths(s, d)),
        "lower_triangle": lambda s, d: P.lower_triangle(P.symmetric(nation_paths(s, d))),
        "common_path_lengths": lambda s, d: T.common_path_lengths(order_arrays(s, d), "ref"),
        "self_distances": lambda s, d: D.self_distances(
            order_structures(s, d), [Variant("f"), Variant("p")]
        ),
        "tree_distances_all_nations": nation_query(*all_variants(0.5)),
    }
    for name, v in PATHS.items():
        result[f"path_distance_{name}"] = structure_query(v)
        result[f"path_distance_{name}_nations"] = nation_query(v)
    return result


def oracle_sql() -> dict:
    orders = ORDER_SQL + ",\n" + CANON_SQL + ",\n" + REF_SQL + ",\n" + DISTINCT_SQL
    nations = NATION_SQL
    matrix = path_sql(PATHS["pftt"], nations, "trees").replace(
        " SELECT 'pftt'", ",\ndist AS (SELECT 'pftt'"
    ) + """),
square AS (
  SELECT target, i, j, d FROM dist UNION ALL SELECT target, j, i, d FROM dist
  UNION ALL SELECT 'pftt', tree_id, tree_id, 0.0::DOUBLE FROM sizes) """
    result = {
        "tree_nodes": _with(ORDER_SQL, NODE_SQL.format(src="trees")) + " SELECT * FROM nodes",
        "token_depths": _with(ORDER_SQL, NODE_SQL.format(src="trees"))
        + """ SELECT tree_id, CAST(pos - 1 AS INTEGER) AS pos, token,
              CAST(depth AS INTEGER) AS depth, CAST(labels AS INTEGER) AS labels FROM levels""",
        "subtree_sizes": _with(NATION_SQL, NODE_SQL.format(src="trees"))
        + " SELECT tree_id, pre, label, size FROM nodes",
        "tree_ref": _with(ORDER_SQL, CANON_SQL, REF_SQL) + " SELECT tree_id, ref FROM refs",
        "canonical_trees": _with(ORDER_SQL, CANON_SQL) + " SELECT tree_id, class, tree FROM canon",
        "structures": _with(orders) + " SELECT tree_id AS ref, tree, n FROM distinct_trees",
        "target_names": """SELECT p_partkey, 'f' || f || 't' || f || CASE WHEN f = 'f'
              THEN CAST(CAST(round(p_size / 100.0::DOUBLE * 100) AS INTEGER) AS VARCHAR) ELSE '' END
              AS target, 'f' || f || 't' || f || CASE WHEN f = 'f'
              THEN CAST(CAST(trunc(p_size / 100.0::DOUBLE * 100) AS INTEGER) AS VARCHAR) ELSE '' END
              AS legacy
              FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 't' ELSE 'f' END AS f FROM part)""",
        "tree_pairs": _with(orders)
        + """ SELECT x.tree_id AS i, y.tree_id AS j
              FROM distinct_trees x JOIN distinct_trees y ON x.tree_id < y.tree_id""",
        "pair_tiles": _with(orders)
        + """ SELECT x.tree_id AS i, y.tree_id AS j, 1 AS tiles
              FROM distinct_trees x JOIN distinct_trees y ON x.tree_id < y.tree_id""",
        "tree_text_roots": """WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^,\\s()]+|[()]')) AS t,
         generate_subscripts(regexp_extract_all(text, '[^,\\s()]+|[()]'), 1) AS pos FROM documents),
levels AS (
  SELECT *, coalesce(sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
  FROM tokens),
found AS (
  SELECT doc_id, count(*) AS roots FROM levels WHERE depth = 0 AND t NOT IN ('(', ')') GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(roots, 0) AS INTEGER) AS roots
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id""",
        "symmetric_matrix": matrix + "SELECT * FROM square",
        "lower_triangle": matrix + "SELECT * FROM square WHERE j <= i",
        "common_path_lengths": path_sql(PATHS["pftt"], orders).replace(
            END_SQL.format(target="pftt"),
            " SELECT i, j, CAST(g / 2 AS INTEGER) AS length FROM best WHERE g > 0",
        ),
        "self_distances": _with(orders, NODE_SQL.format(src="distinct_trees"))
        + """ SELECT v.target, tree_id AS ref, CASE WHEN v.target = 'pttf100'
              THEN 2.0::DOUBLE * (count(*) - max(depth) - 1) ELSE 0.0::DOUBLE END AS d
              FROM nodes, (VALUES ('fttf100'), ('pttf100')) v(target) GROUP BY 1, 2""",
    }
    for name, v in PATHS.items():
        result[f"path_distance_{name}"] = path_sql(v, orders)
        result[f"path_distance_{name}_nations"] = path_sql(v, nations, "trees")
    return result
