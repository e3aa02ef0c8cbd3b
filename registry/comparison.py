"""Registered queries of the multiple comparison, with their SQL."""

from __future__ import annotations

from arbormetric.functions.tails import (
    NORMAL_DENOMINATOR,
    NORMAL_FRACTION,
    NORMAL_NUMERATOR,
    NORMAL_SWITCH,
    SQRT_TWO_PI,
)
from arbormetric.operators import comparison as C
from arbormetric.operators import ranking as R
from arbormetric.plans.comparing import compare_methods
from pyspark.sql import functions as F
from registry.tables import scores_by_day, scores_by_user

DAY_SQL = """scores AS (
  SELECT event_type AS method, strftime(ts, '%Y-%m-%d') AS dataset,
         sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 100.0::DOUBLE) AS score
  FROM events GROUP BY 1, 2)"""
USER_SQL = """all_scores AS (
  SELECT event_type AS method, user_id AS dataset,
         sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 100.0::DOUBLE) AS score
  FROM events GROUP BY 1, 2),
scores AS (
  SELECT * FROM all_scores WHERE dataset IN (
    SELECT dataset FROM all_scores GROUP BY 1
    HAVING count(*) = (SELECT count(DISTINCT method) FROM all_scores)))"""
RANK_SQL = """ranks AS (
  SELECT method, dataset, score,
         rank() OVER (PARTITION BY dataset ORDER BY score DESC)
           + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank
  FROM scores),
means AS (
  SELECT method, avg(rank) AS mean_rank, count(*) AS l, count(*) OVER () AS s
  FROM ranks GROUP BY method)"""


def horner_sql(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_sql(z: str) -> str:
    x = f"abs({z})"
    fraction = f"({x} + {NORMAL_FRACTION!r}::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k} / {fraction})"
    return (
        f"2 * exp(-{x} * {x} / 2) * CASE WHEN {x} < {NORMAL_SWITCH!r} "
        f"THEN {horner_sql(x, NORMAL_NUMERATOR)} / {horner_sql(x, NORMAL_DENOMINATOR)} "
        f"ELSE 1 / {fraction} / {SQRT_TWO_PI!r} END"
    )


PAIR_SQL = """pairs AS (
  SELECT x.method AS a, y.method AS b, x.dataset, y.score - x.score AS diff
  FROM scores x JOIN scores y ON x.dataset = y.dataset AND x.method < y.method)"""
SIGNED_SQL = """signed AS (
  SELECT a, b, dataset, diff,
         rank() OVER (PARTITION BY a, b ORDER BY abs(diff))
           + (count(*) OVER (PARTITION BY a, b, abs(diff)) - 1) / 2.0::DOUBLE AS rank
  FROM pairs),
plus AS (
  SELECT a, b, count(*) AS n, sum(CASE WHEN diff > 0 THEN rank ELSE 0 END) AS w_plus
  FROM signed GROUP BY a, b),
wmax AS (
  SELECT a, b, n, greatest(w_plus, n * (n + 1) / 2 - w_plus) AS w_max FROM plus)"""
EXACT_SQL = """subset_sums(k, total, ways) AS (
  SELECT 0, 0, CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, total + take * (k + 1), sum(ways)
  FROM subset_sums, (VALUES (0), (1)) AS choice(take)
  WHERE k < (SELECT count(DISTINCT dataset) FROM scores)
  GROUP BY k, total + take * (k + 1)),
tests AS (
  SELECT a, b, n, w_max, 2 * (SELECT sum(ways) FROM subset_sums WHERE k = n AND total >= w_max)
         / pow(2.0::DOUBLE, n) AS p
  FROM wmax)"""
NORMAL_SQL = f"""zs AS (
  SELECT a, b, n, w_max, (n * (n + 1) / 2 - w_max - n * (n + 1) / 4 - 0.5::DOUBLE)
         / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z
  FROM wmax),
tests AS (SELECT a, b, n, w_max, {normal_sql("z")} AS p FROM zs)"""
Z_SQL = f"""zs AS (
  SELECT x.method AS a, y.method AS b,
         abs(x.mean_rank - y.mean_rank) / sqrt(x.s * (x.s + 1) / 6.0::DOUBLE / x.l) AS z
  FROM means x JOIN means y ON x.method < y.method),
zp AS (SELECT a, b, z, {normal_sql("z")} AS p FROM zs)"""
CONTROL_SQL = """oriented AS (
  SELECT a AS control, b AS other, p FROM {src}
  UNION ALL SELECT b, a, p FROM {src}),
ranked AS (
  SELECT control, other, p, row_number() OVER (PARTITION BY control ORDER BY p, other) AS i,
         count(*) OVER (PARTITION BY control) AS n
  FROM oriented)"""
HOMMEL_SQL = """bounds AS (
  SELECT r.control, g.j, min(g.j * r.p / (r.i + g.j - r.n)) AS bound
  FROM ranked r, (SELECT unnest(range(1, 1 + (SELECT max(n) FROM ranked))) AS j) g
  WHERE g.j >= r.n - r.i + 1 AND g.j <= r.n GROUP BY 1, 2),
stopped AS (
  SELECT r.control, r.other, r.p, r.n, min(CASE WHEN b.j * r.p > b.bound THEN b.j END) AS stop
  FROM ranked r JOIN bounds b ON r.control = b.control GROUP BY 1, 2, 3, 4)
SELECT control, other, round(p, 9) AS p, round(coalesce(stop - 1, n) * p, 9) AS adjusted
FROM stopped"""
COUNTS_SQL = """hyp(k, t) AS (
  SELECT 0, 0
  UNION
  SELECT h.k + g.j, h.t + g.j * (g.j - 1) // 2
  FROM hyp h, (SELECT unnest(range(1, 1 + (SELECT count(DISTINCT method) FROM scores))) AS j) g
  WHERE h.k + g.j <= (SELECT count(DISTINCT method) FROM scores))"""
SHAFFER_SQL = """ordered AS (
  SELECT a, b, p, row_number() OVER (ORDER BY p, a, b) - 1 AS i, count(*) OVER () AS n FROM zp),
factors AS (
  SELECT o.a, o.b, o.p, o.i, max(h.t) AS t
  FROM ordered o JOIN hyp h ON h.k = (SELECT count(*) FROM means) AND h.t <= o.n - o.i
  GROUP BY 1, 2, 3, 4)
SELECT a, b, round(p, 9) AS p,
       round(least(1.0::DOUBLE, max(t * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS adjusted
FROM factors"""
BH_SQL = """SELECT control, other, round(p, 9) AS p,
  round(least(1.0::DOUBLE, min(p * n / i) OVER (PARTITION BY control ORDER BY p DESC, other DESC
        ROWS UNBOUNDED PRECEDING)), 9) AS q
FROM ranked"""
FRIEDMAN_SQL = """chi AS (
  SELECT s, l, (sum(mean_rank * mean_rank) - s * (s + 1) * (s + 1) / 4.0::DOUBLE) * 12 * l
         / (s * (s + 1)) AS chi2
  FROM means GROUP BY s, l),
fs AS (SELECT s, l, chi2, (l - 1) * chi2 / (l * (s - 1) - chi2) AS f FROM chi),
zs AS (
  SELECT s, l, chi2, f, (s - 1) * (l - 1) / ((s - 1) * (l - 1) + (s - 1) * f) AS z FROM fs)
SELECT s, l, round(chi2, 9) AS chi2, round(f, 9) AS f,
       round(pow(z, (s - 1) * (l - 1) / 2.0::DOUBLE)
             * (1 + (s - 1) * (l - 1) / 2.0::DOUBLE * (1 - z)), 9) AS p
FROM zs"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _methods(scores):
    return scores.select("method").distinct()


def queries() -> dict:
    day, user = scores_by_day, lambda s, d: R.complete_datasets(scores_by_user(s, d))
    return {
        "score_summary": lambda s, d: R.score_summary(scores_by_day(s, d)),
        "completeness_gate": lambda s, d: R.completeness(scores_by_user(s, d)),
        "average_rank": lambda s, d: R.average_rank(day(s, d)),
        "mean_rank": lambda s, d: _rounded(R.mean_rank(R.average_rank(user(s, d))), "mean_rank"),
        "friedman_days": lambda s, d: _rounded(C.friedman(day(s, d)), "chi2", "f", "p"),
        "friedman_users": lambda s, d: _rounded(C.friedman(user(s, d)), "chi2", "f", "p"),
        "method_pairs": lambda s, d: _rounded(C.method_pairs(user(s, d)), "diff"),
        "signed_rank": lambda s, d: _rounded(C.signed_rank(C.method_pairs(user(s, d))), "size"),
        "wilcoxon_exact": lambda s, d: _rounded(C.wilcoxon_pairs(day(s, d)), "p"),
        "wilcoxon_normal": lambda s, d: _rounded(C.wilcoxon_pairs(user(s, d)), "p"),
        "wilcoxon_both_orders": lambda s, d: _rounded(C.wilcoxon_pairs(day(s, d), both=True), "p"),
        "rank_z": lambda s, d: _rounded(C.rank_z(day(s, d)), "z", "p"),
        "hommel": lambda s, d: _rounded(C.hommel(C.rank_z(day(s, d))), "p", "adjusted"),
        "true_hypothesis_counts": lambda s, d: C.true_hypothesis_counts(_methods(day(s, d))),
        "shaffer": lambda s, d: _rounded(C.shaffer(C.rank_z(day(s, d))), "p", "adjusted"),
        "benjamini_hochberg": lambda s, d: _rounded(
            C.benjamini_hochberg(C.wilcoxon_pairs(day(s, d))), "p", "q"
        ),
        "compare_methods_hommel": lambda s, d: _rounded(
            compare_methods(user(s, d))["hommel"], "p", "adjusted"
        ),
    }


def oracle_sql() -> dict:
    test = "SELECT a, b, n, w_max, round(p, 9) AS p FROM tests"
    return {
        "score_summary": _with(DAY_SQL)
        + " SELECT method, count(*) AS n_scores FROM scores GROUP BY 1",
        "completeness_gate": _with(USER_SQL)
        + """ SELECT method, count(*) AS n_scores, any_value(t.n) AS n_datasets,
              count(*) = any_value(t.n) AS complete
              FROM all_scores, (SELECT count(DISTINCT dataset) AS n FROM all_scores) t GROUP BY 1""",
        "average_rank": _with(DAY_SQL, RANK_SQL) + " SELECT * FROM ranks",
        "mean_rank": _with(USER_SQL, RANK_SQL)
        + " SELECT method, round(mean_rank, 9) AS mean_rank FROM means",
        "friedman_days": _with(DAY_SQL, RANK_SQL, FRIEDMAN_SQL),
        "friedman_users": _with(USER_SQL, RANK_SQL, FRIEDMAN_SQL),
        "method_pairs": _with(USER_SQL, PAIR_SQL)
        + " SELECT a, b, dataset, round(diff, 9) AS diff FROM pairs",
        "signed_rank": _with(USER_SQL, PAIR_SQL, SIGNED_SQL)
        + """ SELECT a, b, round(abs(diff), 9) AS size, count(*) AS n,
              CAST(sum(CAST(diff > 0 AS BIGINT)) AS BIGINT) AS n_pos, rank
              FROM signed GROUP BY a, b, abs(diff), rank""",
        "wilcoxon_exact": _with(DAY_SQL, PAIR_SQL, SIGNED_SQL, EXACT_SQL) + test,
        "wilcoxon_normal": _with(USER_SQL, PAIR_SQL, SIGNED_SQL, NORMAL_SQL) + test,
        "wilcoxon_both_orders": _with(DAY_SQL, PAIR_SQL, SIGNED_SQL, EXACT_SQL)
        + test
        + " UNION ALL SELECT b, a, n, w_max, round(p, 9) FROM tests",
        "rank_z": _with(DAY_SQL, RANK_SQL, Z_SQL)
        + " SELECT a, b, round(z, 9) AS z, round(p, 9) AS p FROM zp",
        "hommel": _with(DAY_SQL, RANK_SQL, Z_SQL, CONTROL_SQL.format(src="zp"), HOMMEL_SQL),
        "true_hypothesis_counts": _with(DAY_SQL, COUNTS_SQL) + " SELECT k, t FROM hyp",
        "shaffer": _with(DAY_SQL, RANK_SQL, Z_SQL, COUNTS_SQL, SHAFFER_SQL),
        "benjamini_hochberg": _with(
            DAY_SQL, PAIR_SQL, SIGNED_SQL, EXACT_SQL, CONTROL_SQL.format(src="tests"), BH_SQL
        ),
        "compare_methods_hommel": _with(
            USER_SQL, RANK_SQL, Z_SQL, CONTROL_SQL.format(src="zp"), HOMMEL_SQL
        ),
    }
