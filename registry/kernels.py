"""Registered queries of polynomials and model selection, with their SQL."""

from __future__ import annotations

from arbormetric.operators import polynomials as K
from arbormetric.operators import search as G
from arbormetric.plans.searching import search_kernel
from pyspark.sql import functions as F
from registry.tables import part_polynomials, segment_labels, segment_terms, table

A, B, C = K.Range(0.0, 1.0, 4), K.Range(0.0, 1.0, 4), K.Range(-3.0, 3.0, 4)


def valid_sql(column: str) -> str:
    """Whether a text is a polynomial, by taking its terms apart: what is left of a term without its
    number, a star behind that and its exponents has to be one of a few products."""
    terms = f"regexp_extract_all({column}, '[+-]?[^+-]+')"
    bare = "ltrim(t, '+-')"
    number = f"regexp_extract({bare}, '^[0-9]+[.]?[0-9]*')"
    rest = f"substr({bare}, len({number}) + 1)"
    star = f"({number} <> '' AND starts_with({rest}, '*'))"
    product = f"regexp_replace(CASE WHEN {star} THEN substr({rest}, 2) ELSE {rest} END, '([xy])\\^[0-9]+', '\\1', 'g')"
    fits = f"""(CASE WHEN {product} = '' THEN {number} <> '' AND NOT {star}
      ELSE {product} IN ('x', 'y', 'xy', 'yx', 'x*y', 'y*x') END)"""
    return f"""({column} <> '' AND array_to_string({terms}, '') = {column}
    AND list_bool_and(list_transform({terms}, lambda t: {fits})))"""


TEXT_SQL = """texts AS (
  SELECT p_partkey AS id,
         p_size || '*x^2*y-' || (p_size % 7) || 'y^' || (p_partkey % 3 + 1) || 'x+y-2.5*y+3'
           || CASE WHEN p_partkey % 10 = 0 THEN '*x*x' ELSE '' END AS p,
         '-' || p_size || 'x^2y+1.5*y-0.25' AS q
  FROM part)"""


def terms_sql(column: str, name: str) -> str:
    def exponent(v: str) -> str:
        power = f"regexp_extract(t, '{v}\\^(\\d+)', 1)"
        return (
            f"CASE WHEN NOT contains(t, '{v}') THEN 0 WHEN {power} = '' THEN 1 "
            f"ELSE CAST({power} AS INTEGER) END"
        )

    number = "regexp_extract(t, '^[+-]?(\\d+\\.?\\d*)', 1)"
    return f"""{name}_raw AS (
  SELECT id, unnest(regexp_extract_all({column}, '[+-]?[^+-]+')) AS t FROM texts
  WHERE {valid_sql(column)}),
{name}_all AS (
  SELECT id, {exponent("x")} AS ex, {exponent("y")} AS ey,
         CASE WHEN starts_with(t, '-') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END
         * CASE WHEN {number} = '' THEN 1.0::DOUBLE ELSE CAST({number} AS DOUBLE) END AS coef
  FROM {name}_raw),
""" + reduced_sql(f"{name}_all", name)


def reduced_sql(source: str, name: str, keys: str = "id") -> str:
    return f"""{name}_sum AS (
  SELECT {keys}, ex, ey, sum(coef) AS coef FROM {source} GROUP BY {keys}, ex, ey),
{name} AS (
  SELECT {keys}, ex, ey, coef FROM {name}_sum WHERE coef <> 0
  UNION ALL
  SELECT {keys}, 0, 0, 0.0::DOUBLE FROM {name}_sum GROUP BY {keys}
  HAVING count(*) FILTER (WHERE coef <> 0) = 0)"""


BOTH_SQL = TEXT_SQL + ",\n" + terms_sql("p", "tp") + ",\n" + terms_sql("q", "tq")
TERM_END = " SELECT id, ex, ey, round(coef, 9) AS coef FROM {name}"
PROFILE_SQL = """profiles AS (
  SELECT CAST(c_nationkey * 5 + list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD',
           'MACHINERY'], c_mktsegment) AS BIGINT) AS id,
         CASE WHEN any_value(n_regionkey) < 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
         {shares}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1)""".format(
    shares=",\n         ".join(
        f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) / (count(*) * 1.0::DOUBLE) AS {n}"
        for n, c in [
            *[(f"p{k}", f"substr(o_orderpriority, 1, 1) = '{k}'") for k in range(1, 6)],
            ("s1", "o_orderstatus = 'F'"),
            ("s2", "o_orderstatus = 'O'"),
            ("s3", "o_orderstatus = 'P'"),
            ("w", "CAST(round(o_totalprice * 100) AS BIGINT) > 25000000"),
        ]
    )
)
GRAM_SQL = PROFILE_SQL + """,
grid AS (
  SELECT a.s - 1 AS a_ix, b.s AS b_ix, 0.0::DOUBLE * (1.0::DOUBLE - a.s / 4.0::DOUBLE) + 1.0::DOUBLE * a.s / 4 AS alpha,
         0.0::DOUBLE * (1.0::DOUBLE - b.s / 4.0::DOUBLE) + 1.0::DOUBLE * b.s / 4 AS beta
  FROM (SELECT unnest(range(1, 5)) AS s) a, (SELECT unnest(range(0, 5)) AS s) b
  WHERE a.s >= b.s),
gram AS (
  SELECT a.id AS i, b.id AS j, g.a_ix, g.b_ix, g.alpha, g.beta,
         a.w * b.w + (a.s1 * b.s1 + a.s2 * b.s2 + a.s3 * b.s3) * g.beta
         + (a.p1 * b.p1 + a.p2 * b.p2 + a.p3 * b.p3 + a.p4 * b.p4 + a.p5 * b.p5) * g.alpha AS v
  FROM profiles a JOIN profiles b ON a.id <= b.id, grid g)"""
GRAM_END = """ SELECT i, j, CAST(a_ix AS INTEGER) AS a_ix, CAST(b_ix AS INTEGER) AS b_ix,
  alpha, beta, round({v}, 9) AS v FROM gram"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def p_terms(spark, sf_dir):
    return K.poly_terms(part_polynomials(spark, sf_dir), "p", ["id"])


def q_terms(spark, sf_dir):
    return K.poly_terms(part_polynomials(spark, sf_dir), "q", ["id"])


def half_gram(spark, sf_dir):
    return K.poly_eval(segment_terms(spark, sf_dir), A, B)


def full_terms(spark, sf_dir):
    half = segment_terms(spark, sf_dir)
    turned = half.filter("i < j").select(
        F.col("j").alias("i"), F.col("i").alias("j"), "ex", "ey", "coef"
    )
    return half.unionByName(turned)


def search(spark, sf_dir):
    return search_kernel(full_terms(spark, sf_dir), segment_labels(spark, sf_dir), A, B, C,
                         norm=True)


def size_grid(spark, sf_dir):
    """Parameter grids per brand, from the smallest and the largest part."""
    limits = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        *[
            value.alias(f"{name}_{end}")
            for name in "abc"
            for end, value in (
                ("min", F.min("p_size").cast("double")),
                ("max", F.max("p_size").cast("double")),
                ("div", F.lit(4)),
            )
        ]
    )
    return K.param_grid(limits)


def price_outcomes(spark, sf_dir):
    """Predictions of a price rule for all orders at several thresholds, as grid outcomes."""
    orders = table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)
    steps = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c_ix")
    points = orders.select("o_totalprice", y.alias("y"), steps)
    rule = F.when(F.col("o_totalprice") > F.col("c_ix") * 100000, 1.0).otherwise(-1.0)
    return G.confusion(
        points.select(
            F.lit(0).alias("a_ix"), F.lit(0).alias("b_ix"), "c_ix", F.lit(1.0).alias("alpha"),
            F.lit(1.0).alias("beta"), F.col("c_ix").cast("double").alias("logc"), "y",
            rule.alias("predicted"),
        )
    )


OUTCOME_SQL = """WITH o AS (
  SELECT c_ix, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS y,
         CASE WHEN o_totalprice > c_ix * 100000 THEN 1 ELSE -1 END AS p
  FROM orders, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS c_ix)),
c AS (
  SELECT 0 AS a_ix, 0 AS b_ix, c_ix, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta,
         CAST(c_ix AS DOUBLE) AS logc,
         count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = -1 AND p = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND p = -1) AS fn, count(*) FILTER (WHERE y = -1 AND p = -1) AS tn
  FROM o GROUP BY c_ix),
s AS (
  SELECT *, fp + fn AS error, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy
  FROM c)"""


def queries() -> dict:
    return {
        "poly_terms": lambda s, d: p_terms(s, d),
        "poly_rejects": lambda s, d: K.poly_rejects(part_polynomials(s, d), "p"),
        "poly_add": lambda s, d: K.poly_add(p_terms(s, d), q_terms(s, d), ["id"]),
        "poly_sub": lambda s, d: K.poly_sub(p_terms(s, d), p_terms(s, d), ["id"]),
        "poly_mul": lambda s, d: K.poly_mul(p_terms(s, d), q_terms(s, d), ["id"]),
        "poly_add_scalar": lambda s, d: K.poly_add_scalar(p_terms(s, d), -3.0, ["id"]),
        "poly_scale": lambda s, d: K.poly_scale(p_terms(s, d), 0.5, ["id"]),
        "poly_format": lambda s, d: K.poly_format(p_terms(s, d), ["id"]),
        "poly_eval": half_gram,
        "normalize_gram": lambda s, d: _rounded(K.normalize_gram(half_gram(s, d)), "v"),
        "param_grid": size_grid,
        "stratified_folds": lambda s, d: G.stratified_folds(segment_labels(s, d), 5),
        "confusion": price_outcomes,
        "accuracy": lambda s, d: _rounded(G.with_accuracy(price_outcomes(s, d)), "accuracy"),
        "select_model": lambda s, d: _rounded(G.select_model(price_outcomes(s, d)), "accuracy"),
        "optimal_points": lambda s, d: _rounded(G.optimal_points(price_outcomes(s, d)), "accuracy"),
        "grid_cv": lambda s, d: G.grid_cv(
            K.poly_eval(full_terms(s, d), A, B), segment_labels(s, d), C
        ),
        "search_kernel": lambda s, d: search(s, d)["best"],
    }


def oracle_sql() -> dict:
    w = "WITH "
    combined = reduced_sql("(SELECT * FROM tp UNION ALL SELECT * FROM tq)", "r")
    return {
        "poly_terms": w + BOTH_SQL + " SELECT * FROM tp",
        "poly_rejects": w + TEXT_SQL + f" SELECT * FROM texts WHERE NOT {valid_sql('p')}",
        "poly_add": w + BOTH_SQL + ",\n" + combined + " SELECT * FROM r",
        "poly_sub": w + BOTH_SQL + " SELECT DISTINCT id, 0 AS ex, 0 AS ey, 0.0::DOUBLE AS coef FROM tp",
        "poly_mul": w + BOTH_SQL + """,
products AS (
  SELECT a.id, a.ex + b.ex AS ex, a.ey + b.ey AS ey, a.coef * b.coef AS coef
  FROM tp a JOIN tq b ON a.id = b.id),
""" + reduced_sql("products", "r") + " SELECT * FROM r",
        "poly_add_scalar": w + BOTH_SQL + ",\n" + reduced_sql(
            "(SELECT * FROM tp UNION ALL SELECT DISTINCT id, 0, 0, -3.0::DOUBLE FROM tp)", "r"
        ) + " SELECT * FROM r",
        "poly_scale": w + BOTH_SQL + " SELECT id, ex, ey, coef * 0.5 AS coef FROM tp",
        "poly_format": w + BOTH_SQL + """,
pieces AS (
  SELECT id, ex, ey, coef, CASE WHEN coef < 0 THEN '-'
      WHEN row_number() OVER (PARTITION BY id ORDER BY ex DESC, ey DESC) > 1 THEN '+' ELSE '' END
    || CAST(abs(coef) AS VARCHAR)
    || CASE ex WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'x^' || ex END
    || CASE ey WHEN 0 THEN '' WHEN 1 THEN 'y' ELSE 'y^' || ey END AS t
  FROM tp)
SELECT id, string_agg(t, '' ORDER BY ex DESC, ey DESC) AS text FROM pieces GROUP BY id""",
        "poly_eval": w + GRAM_SQL + GRAM_END.replace("round({v}, 9) AS v", "v"),
        "normalize_gram": w + GRAM_SQL.replace("gram AS (", "plain AS (").replace(
            "profiles AS (", "profiles AS MATERIALIZED ("
        ) + """,
diagonal AS MATERIALIZED (
  SELECT a.id, g.a_ix, g.b_ix,
         a.w * a.w + (a.s1 * a.s1 + a.s2 * a.s2 + a.s3 * a.s3) * g.beta
         + (a.p1 * a.p1 + a.p2 * a.p2 + a.p3 * a.p3 + a.p4 * a.p4 + a.p5 * a.p5) * g.alpha AS v
  FROM profiles a, grid g),
gram AS (
  SELECT p.i, p.j, p.a_ix, p.b_ix, p.alpha, p.beta, p.v / sqrt(x.v * y.v) AS v
  FROM plain p JOIN diagonal x ON x.id = p.i AND x.a_ix = p.a_ix AND x.b_ix = p.b_ix
  JOIN diagonal y ON y.id = p.j AND y.a_ix = p.a_ix AND y.b_ix = p.b_ix)"""
        + GRAM_END.format(v="v"),
        "param_grid": """WITH limits AS (
  SELECT p_brand, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi
  FROM part GROUP BY 1),
steps AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS s),
vals AS (SELECT p_brand, s, lo * (1.0::DOUBLE - s / 4.0::DOUBLE) + hi * s / 4 AS v FROM limits, steps)
SELECT a.p_brand, a.s - 1 AS a_ix, a.v AS alpha, b.s AS b_ix, b.v AS beta, c.s AS c_ix, c.v AS logc
FROM vals a JOIN vals b ON a.p_brand = b.p_brand JOIN vals c ON a.p_brand = c.p_brand
WHERE a.s >= 1 AND a.v >= b.v""",
        "stratified_folds": w + PROFILE_SQL + """
SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY id) - 1) % 5 AS INTEGER) AS fold
FROM profiles""",
        "confusion": OUTCOME_SQL + " SELECT * FROM c",
        "accuracy": OUTCOME_SQL + " SELECT * FROM s",
        "select_model": OUTCOME_SQL + " SELECT * FROM s ORDER BY error, a_ix, b_ix, c_ix LIMIT 1",
        "optimal_points": OUTCOME_SQL + " SELECT * FROM s WHERE error = (SELECT min(error) FROM s)",
    }
