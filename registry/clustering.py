"""Registered queries of clustering and its evaluation, with their SQL."""

from __future__ import annotations

from arbormetric.operators import clustering as H
from arbormetric.operators import evaluation as E
from arbormetric.operators.variants import Variant
from arbormetric.plans.clustering import compare_targets, compare_tree_distances
from pyspark.sql import functions as F
from registry.distances import level_sql
from registry.tables import (
    brand_classes,
    brand_distances,
    nation_trees,
    order_clusters,
    order_trees,
    table,
)
from registry.trees import (
    CANON_SQL,
    CONTIGUOUS_SQL,
    DISTINCT_SQL,
    NATION_SQL,
    NODE_SQL,
    ORDER_SQL,
    PAIR_SQL,
    REF_SQL,
)

BRAND_SQL = """profiles AS (
  SELECT l_returnflag || l_linestatus AS target,
         CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id,
         sum(CAST(l_quantity AS BIGINT)) / (count(*) * 1.0::DOUBLE) AS x,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 1.0::DOUBLE) AS y,
         sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 1.0::DOUBLE) AS z
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
dist AS (
  SELECT a.target, a.id AS i, b.id AS j,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))
           AS d
  FROM profiles a JOIN profiles b ON a.target = b.target AND a.id < b.id)"""
BRAND_CLASS_SQL = """class_counts AS (
  SELECT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id, p_type, count(*) AS n
  FROM part GROUP BY 1, 2),
classes AS (
  SELECT id, first(p_type ORDER BY n DESC, p_type) AS class, 1 AS n FROM class_counts GROUP BY 1)"""
# State: the pairs of clusters left at a step, the closest one in every row.
HAC_SQL = """state(target, step, i, j, d, ni, nj) AS (
  SELECT target, 1, i, j, {square}, {ni}, {nj} FROM dist {weights}
  UNION ALL
  SELECT target, step + 1, i, j, {value}, max(na), max(nb)
  FROM (
    SELECT target, step, least(ri, rj) AS i, greatest(ri, rj) AS j, d, ni, nj, bd, bi, p,
           CASE WHEN ri < rj THEN wi ELSE wj END AS na, CASE WHEN ri < rj THEN wj ELSE wi END AS nb,
           CASE WHEN ri = bi OR rj = bi THEN 1 ELSE 0 END AS touched,
           CASE WHEN ri = bi THEN wi ELSE wj END AS nm, CASE WHEN ri = bi THEN wj ELSE wi END AS nz
    FROM (
      SELECT target, step, i, j, d, ni, nj, b.d AS bd, b.i AS bi, b.ni * b.nj AS p,
             CASE WHEN i = b.j THEN b.i ELSE i END AS ri,
             CASE WHEN j = b.j THEN b.i ELSE j END AS rj,
             CASE WHEN i IN (b.i, b.j) THEN b.ni + b.nj ELSE ni END AS wi,
             CASE WHEN j IN (b.i, b.j) THEN b.ni + b.nj ELSE nj END AS wj
      FROM (
        SELECT *, first_value(struct_pack(d := d, i := i, j := j, ni := ni, nj := nj))
                    OVER (PARTITION BY target ORDER BY d, i, j) AS b
        FROM state)
      WHERE NOT (i = b.i AND j = b.j)))
  GROUP BY target, step, i, j),
merges AS (
  SELECT target, step, first(i ORDER BY d, i, j) AS "left", first(j ORDER BY d, i, j) AS "right",
         {root} AS height, CAST(first(ni + nj ORDER BY d, i, j) AS BIGINT) AS size
  FROM state GROUP BY 1, 2)"""
LINK_VALUES = {
    "single": "min(d)",
    "complete": "max(d)",
    "upgma": "CASE WHEN max(touched) = 1 THEN sum(ni * nj * d) / sum(ni * nj) ELSE max(d) END",
    "wpgma": "avg(d)",
    "ward": """CASE WHEN max(touched) = 1
      THEN (sum((ni + nj) * d) - max(nz) * max(bd)) / (max(nm) + max(nz)) ELSE max(d) END""",
    "upgmc": """CASE WHEN max(touched) = 1 THEN sum(ni * nj * d) / sum(ni * nj)
      - max(p) * max(bd) / (max(nm) * max(nm)) ELSE max(d) END""",
    "wpgmc": "CASE WHEN max(touched) = 1 THEN avg(d) - max(bd) / 4 ELSE max(d) END",
}
CUT_SQL = """grown(target, step, id, cluster) AS (
  SELECT target, 0, id, id FROM (
    SELECT target, "left" AS id FROM merges UNION SELECT target, "right" FROM merges)
  UNION ALL
  SELECT w.target, w.step + 1, w.id, CASE WHEN w.cluster = m."right" THEN m."left" ELSE w.cluster END
  FROM grown w JOIN merges m ON m.target = w.target AND m.step = w.step + 1),
assigned AS (
  SELECT w.target, n.items - w.step AS k, w.id, w.cluster
  FROM grown w JOIN (SELECT target, count(*) + 1 AS items FROM merges GROUP BY 1) n
    ON n.target = w.target
  WHERE n.items - w.step BETWEEN 2 AND {k_max})"""
AGREE_SQL = """cells AS (
  SELECT target, k, cluster, class, CAST(sum(c.n) AS BIGINT) AS n
  FROM assigned a JOIN classes c ON a.id = c.id GROUP BY 1, 2, 3, 4),
inner_sums AS (
  SELECT target, k, sum(n * (n - 1) / 2.0::DOUBLE) AS t, sum(n) AS items,
         ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM cells GROUP BY 1, 2),
row_sums AS (
  SELECT target, k, sum(n * (n - 1) / 2.0::DOUBLE) AS p, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h
  FROM (SELECT target, k, cluster, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
col_sums AS (
  SELECT target, k, sum(n * (n - 1) / 2.0::DOUBLE) AS q, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h
  FROM (SELECT target, k, class, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
scores AS (
  SELECT i.target, i.k,
         (t - p * q / (items * (items - 1) / 2.0::DOUBLE))
           / ((p + q) / 2 - p * q / (items * (items - 1) / 2.0::DOUBLE)) AS ari,
         2 - 2 * i.h / (r.h + c.h) AS nmi
  FROM inner_sums i JOIN row_sums r ON i.target = r.target AND i.k = r.k
  JOIN col_sums c ON i.target = c.target AND i.k = c.k)"""
FLAT_SQL = """assigned AS (
  SELECT 'status' AS target, 3 AS k, o_orderkey AS id, o_orderstatus AS cluster FROM orders
  UNION ALL SELECT 'month', 12, o_orderkey, CAST(month(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT 'price', 10, o_orderkey,
                   CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) FROM orders),
classes AS (SELECT o_orderkey AS id, o_orderpriority AS class, 1 AS n FROM orders)"""
SCORE_END = " SELECT target, CAST(k AS INTEGER) AS k, round(ari, 9) AS ari, round(nmi, 9) AS nmi FROM scores"
MERGE_END = ' SELECT target, step, "left", "right", round(height, 9) AS height, size FROM merges'
TREE_SQL = ",\n".join(
    [NATION_SQL, CANON_SQL, REF_SQL, DISTINCT_SQL, NODE_SQL.format(src="distinct_trees"), PAIR_SQL,
     CONTIGUOUS_SQL.format(miss="0.0::DOUBLE", keep=0),
     """classes AS (SELECT ref AS id, class, count(*) AS n FROM refs GROUP BY 1, 2),
dist AS (
  SELECT 'pftt' AS target, p.i, p.j, p.total - coalesce(b.g, 0) AS d
  FROM tree_pairs p LEFT JOIN best b ON p.i = b.i AND p.j = b.j)"""]
)
K_MAX = 20
TIES = 4


def hac_sql(link: str, weighted: bool = False) -> str:
    squared = link in H.SQUARED
    return HAC_SQL.format(
        square="d * d" if squared else "d",
        root="sqrt(greatest(0, first(d ORDER BY d, i, j)))" if squared else "first(d ORDER BY d, i, j)",
        value=LINK_VALUES[link],
        ni="CAST(wi.n AS DOUBLE)" if weighted else "1.0::DOUBLE",
        nj="CAST(wj.n AS DOUBLE)" if weighted else "1.0::DOUBLE",
        weights="""JOIN distinct_trees wi ON wi.tree_id = i
          JOIN distinct_trees wj ON wj.tree_id = j""" if weighted else "",
    )


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


# Shapes under which equal trees are at 0, so that a structure stands for all orders that have it.
ORDER_VARIANTS = (Variant("t", False, False, 0.5), Variant("s", True, False, 0.5))


def order_sql(variant: Variant, link: str) -> str:
    """Clustering of the structures of all orders, weighted by their orders, against priorities."""
    orders = ",\n".join([ORDER_SQL, CANON_SQL, REF_SQL, DISTINCT_SQL])
    parts = [
        orders,
        "classes AS (SELECT ref AS id, class, count(*) AS n FROM refs GROUP BY 1, 2)",
        f"dist AS MATERIALIZED ({level_sql(variant, orders, 'distinct_trees')})",
    ]
    return _with(*parts, hac_sql(link, True), CUT_SQL.format(k_max=K_MAX), AGREE_SQL) + SCORE_END


def brand_scores(spark, sf_dir, link="complete"):
    return compare_targets(
        brand_distances(spark, sf_dir), brand_classes(spark, sf_dir), link, K_MAX
    )


def flat_scores(spark, sf_dir):
    return E.agreement(E.contingency(*order_clusters(spark, sf_dir)))


def flat_entropy(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    return E.entropy(orders, ["o_orderpriority", "o_orderstatus"], ["month"])


def order_classes(spark, sf_dir):
    return order_clusters(spark, sf_dir)[1]


def tree_scores(spark, sf_dir, *variants, link="complete"):
    return compare_tree_distances(order_trees(spark, sf_dir), list(variants), link, K_MAX)


def nation_scores(spark, sf_dir, *variants, link="complete"):
    return compare_tree_distances(nation_trees(spark, sf_dir), list(variants), link, K_MAX)


def tied_distances(spark, sf_dir):
    """Brand distances cut to few values, so that most of them tie."""
    return brand_distances(spark, sf_dir).withColumn("d", F.floor(F.col("d") * TIES).cast("double"))


def queries() -> dict:
    pftt = Variant("p", False, True)
    result = {
        "class_counts": lambda s, d: E.class_counts(order_classes(s, d)),
        "class_encoding": lambda s, d: E.encode_classes(order_classes(s, d)),
        "entropy": lambda s, d: _rounded(flat_entropy(s, d), "entropy"),
        "contingency": lambda s, d: E.contingency(*order_clusters(s, d)),
        "adjusted_rand": lambda s, d: _rounded(E.adjusted_rand(*order_clusters(s, d)), "ari"),
        "normalized_mutual_info": lambda s, d: _rounded(
            E.normalized_mutual_info(*order_clusters(s, d)), "nmi"
        ),
        "best_per_target": lambda s, d: _rounded(
            E.best_per_target(flat_scores(s, d)), "best_ari", "best_nmi"
        ),
        "measures_as_scores": lambda s, d: _rounded(
            E.measures_as_scores(flat_scores(s, d)), "score"
        ),
        "cut": lambda s, d: H.cut(H.hac(brand_distances(s, d), "upgma"), K_MAX),
        "cut_by_jumping": lambda s, d: H.cut_by_jumping(
            H.hac(brand_distances(s, d), "complete"), K_MAX
        ),
        "compare_targets": lambda s, d: _rounded(brand_scores(s, d)["scores"], "ari", "nmi"),
        "pivot_by_k": lambda s, d: brand_scores(s, d, "ward")["ari_by_k"],
        "compare_tree_distances": lambda s, d: _rounded(
            tree_scores(s, d, ORDER_VARIANTS[0])["scores"], "ari", "nmi"
        ),
        "compare_tree_distances_upgma": lambda s, d: _rounded(
            tree_scores(s, d, ORDER_VARIANTS[1], link="upgma")["scores"], "ari", "nmi"
        ),
        "compare_tree_distances_nations": lambda s, d: _rounded(
            nation_scores(s, d, pftt)["scores"], "ari", "nmi"
        ),
        "compare_tree_distances_upgma_nations": lambda s, d: _rounded(
            nation_scores(s, d, pftt, link="upgma")["scores"], "ari", "nmi"
        ),
        "pivot_nmi_by_k": lambda s, d: brand_scores(s, d)["nmi_by_k"],
        "compare_edit_distances": lambda s, d: _rounded(
            tree_scores(s, d, Variant("f"), Variant("s"), Variant("t", False))["best"],
            "best_ari", "best_nmi",
        ),
    }
    for link in H.LINKS:
        result[f"hac_{link}"] = lambda s, d, link=link: _rounded(
            H.hac(brand_distances(s, d), link), "height"
        )
    for link in ("single", "complete"):
        result[f"hac_tied_{link}"] = lambda s, d, link=link: H.hac(tied_distances(s, d), link)
        result[f"hac_tied_rounds_{link}"] = lambda s, d, link=link: H.hac(
            tied_distances(s, d), link, group_limit=18
        )
    for link in H.REDUCIBLE:
        result[f"hac_rounds_{link}"] = lambda s, d, link=link: _rounded(
            H.hac(brand_distances(s, d), link, group_limit=12), "height"
        )
    return result


def oracle_sql() -> dict:
    result = {
        "class_counts": "SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1",
        "class_encoding": """WITH f AS (
              SELECT o_orderpriority AS class, min(o_orderkey) AS first_id FROM orders GROUP BY 1),
            x AS (SELECT class, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS INTEGER) AS class_ix
                  FROM f)
            SELECT o_orderkey AS id, o_orderpriority AS class, class_ix
            FROM orders JOIN x ON o_orderpriority = class""",
        "entropy": """WITH c AS (
              SELECT month(o_orderdate) AS month, count(*) AS n FROM orders
              GROUP BY 1, o_orderpriority, o_orderstatus)
            SELECT CAST(month AS INTEGER) AS month,
                   round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) AS entropy FROM c GROUP BY 1""",
        "contingency": _with(FLAT_SQL, AGREE_SQL) + " SELECT * FROM cells",
        "adjusted_rand": _with(FLAT_SQL, AGREE_SQL)
        + " SELECT target, k, round(ari, 9) AS ari FROM scores",
        "normalized_mutual_info": _with(FLAT_SQL, AGREE_SQL)
        + " SELECT target, k, round(nmi, 9) AS nmi FROM scores",
        "best_per_target": _with(FLAT_SQL, AGREE_SQL)
        + """ SELECT target, round(max(ari), 9) AS best_ari, round(max(nmi), 9) AS best_nmi
              FROM scores GROUP BY 1""",
        "measures_as_scores": _with(FLAT_SQL, AGREE_SQL)
        + """ SELECT target AS method, 'ari@' || k AS dataset, round(ari, 9) AS score FROM scores
              UNION ALL SELECT target, 'nmi@' || k, round(nmi, 9) FROM scores""",
        "cut": _with(BRAND_SQL, hac_sql("upgma"), CUT_SQL.format(k_max=K_MAX))
        + " SELECT target, CAST(k AS INTEGER) AS k, id, cluster FROM assigned",
        "cut_by_jumping": _with(BRAND_SQL, hac_sql("complete"), CUT_SQL.format(k_max=K_MAX))
        + " SELECT target, CAST(k AS INTEGER) AS k, id, cluster FROM assigned",
        "compare_targets": _with(
            BRAND_SQL, BRAND_CLASS_SQL, hac_sql("complete"), CUT_SQL.format(k_max=K_MAX), AGREE_SQL
        )
        + SCORE_END,
        "pivot_by_k": _with(
            BRAND_SQL, BRAND_CLASS_SQL, hac_sql("ward"), CUT_SQL.format(k_max=K_MAX), AGREE_SQL
        )
        + " SELECT target, "
        + ", ".join(
            f'max(CASE WHEN k = {k} THEN round(ari, 2) + 0.0 END) AS "{k}"' for k in range(2, K_MAX + 1)
        )
        + " FROM scores GROUP BY target",
        "pivot_nmi_by_k": _with(
            BRAND_SQL, BRAND_CLASS_SQL, hac_sql("complete"), CUT_SQL.format(k_max=K_MAX), AGREE_SQL
        )
        + " SELECT target, "
        + ", ".join(
            f'max(CASE WHEN k = {k} THEN round(nmi, 2) + 0.0 END) AS "{k}"' for k in range(2, K_MAX + 1)
        )
        + " FROM scores GROUP BY target",
        "compare_tree_distances": order_sql(ORDER_VARIANTS[0], "complete"),
        "compare_tree_distances_upgma": order_sql(ORDER_VARIANTS[1], "upgma"),
        "compare_tree_distances_nations": _with(
            TREE_SQL, hac_sql("complete", True), CUT_SQL.format(k_max=K_MAX), AGREE_SQL
        )
        + SCORE_END,
        "compare_tree_distances_upgma_nations": _with(
            TREE_SQL, hac_sql("upgma", True), CUT_SQL.format(k_max=K_MAX), AGREE_SQL
        )
        + SCORE_END,
    }
    for link in H.LINKS:
        result[f"hac_{link}"] = _with(BRAND_SQL, hac_sql(link)) + MERGE_END
    for link in ("single", "complete"):
        tied = _with(BRAND_SQL.replace("dist AS (", "exact_dist AS ("),
                     f"dist AS (SELECT target, i, j, floor(d * {TIES}) AS d FROM exact_dist)", hac_sql(link))
        result[f"hac_tied_{link}"] = result[f"hac_tied_rounds_{link}"] = tied + MERGE_END
    for link in H.REDUCIBLE:
        result[f"hac_rounds_{link}"] = result[f"hac_{link}"]
    return result
