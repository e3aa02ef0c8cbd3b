import itertools
import math

import pytest
from pyspark.sql import functions as F

from arbormetric.functions.tails import f_upper_p_even, f_upper_p_odd, normal_two_sided_p
from arbormetric.operators import comparison as C
from arbormetric.operators import ranking as R
from arbormetric.operators.ordering import cumulative_counts
from arbormetric.plans.comparing import compare_methods


@pytest.fixture(scope="module")
def scores(spark):
    values = {"A": (3, 1), "B": (3, 2), "C": (1, 2)}
    rows = [(m, d, float(v)) for m, vs in values.items() for d, v in enumerate(vs)]
    return spark.createDataFrame(rows, "method string, dataset long, score double")


def test_ranks_and_friedman(scores):
    ranks = {(r.method, r.dataset): r.rank for r in R.average_rank(scores).collect()}
    assert [ranks["A", 0], ranks["A", 1]] == [1.5, 3]
    assert [ranks["B", 0], ranks["B", 1]] == [1.5, 1.5]
    assert [ranks["C", 0], ranks["C", 1]] == [3, 1.5]
    row = C.friedman(scores).first()
    assert (row.chi2, row.f, row.p) == pytest.approx((0.75, 0.75 / 3.25, 0.8125))


def test_agreeing_ranks_give_zero(spark):
    rows = [(m, d, float(v)) for d in range(3) for v, m in enumerate("ABC")]
    df = spark.createDataFrame(rows, "method string, dataset long, score double")
    assert C.friedman(df).first().p == 0.0


def pvals(spark, *ps, pairs=(("A", "B"), ("A", "C"), ("A", "D"))):
    rows = [(a, b, p) for (a, b), p in zip(pairs, ps)]
    return spark.createDataFrame(rows, "a string, b string, p double")


def test_hommel_and_bh_by_hand(spark):
    p = pvals(spark, 0.01, 0.02, 0.04)
    got = C.hommel(p, "A").orderBy("other").collect()
    assert [r.adjusted for r in got] == pytest.approx([0.03, 0.04, 0.04])
    got = C.benjamini_hochberg(p).filter("control = 'A'").orderBy("other").collect()
    assert [r.q for r in got] == pytest.approx([0.03, 0.03, 0.04])


def test_shaffer_by_hand(spark):
    p = pvals(spark, 0.01, 0.02, 0.04, pairs=(("A", "B"), ("A", "C"), ("B", "C")))
    got = C.shaffer(p).orderBy("p").collect()
    assert [r.adjusted for r in got] == pytest.approx([0.03, 0.03, 0.04])


def test_true_hypothesis_counts(spark):
    methods = spark.createDataFrame([(m,) for m in "ABCD"], "method string")
    got = sorted((r.k, r.t) for r in C.true_hypothesis_counts(methods).collect())
    assert [t for k, t in got if k == 3] == [0, 1, 3]
    assert [t for k, t in got if k == 4] == [0, 1, 2, 3, 6]


def test_exact_signed_rank_by_listing(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.5, 1.0, 5.0, 8.0, 5.0, 11.0]
    rows = [("A", n, v) for n, v in enumerate(a)] + [("B", n, v) for n, v in enumerate(b)]
    df = spark.createDataFrame(rows, "method string, dataset long, score double")
    size = [abs(y - x) for x, y in zip(a, b)]
    rank = [sum(s < t for s in size) + (sum(s == t for s in size) + 1) / 2 for t in size]
    plus = sum(r for r, x, y in zip(rank, a, b) if y > x)
    top = max(plus, 21 - plus)
    sums = [sum(c) for n in range(7) for c in itertools.combinations(range(1, 7), n)]
    row = C.wilcoxon_pairs(df).first()
    assert row.w_max == top
    assert row.p == pytest.approx(2 * sum(s >= top for s in sums) / 64)


def test_tails(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.5, 6.9, 7.5, 12.0, -2.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-6, abs=1e-15)
    rows = [(0.5, 4, 20), (2.5, 4, 116), (7.0, 2, 9), (1.0, 6, 3)]
    even = spark.createDataFrame(rows, "f double, d1 int, d2 int")
    args = [F.col(c).cast("double") for c in ("f", "d1", "d2")]
    exact, fraction = even.select(
        f_upper_p_even(*map(F.col, ("f", "d1", "d2"))), f_upper_p_odd(*args)
    ).toPandas().T.to_numpy()
    assert list(exact) == pytest.approx(list(fraction), rel=1e-10)
    # One degree of freedom against one: the squared Cauchy variable.
    one = spark.createDataFrame([(3.0, 1.0, 1.0)], "f double, d1 double, d2 double")
    got = one.select(f_upper_p_odd("f", "d1", "d2")).first()[0]
    assert got == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(3.0)))


def test_cumulative_counts_with_heavy_ties(spark):
    values = [0] * 500 + list(range(1, 700)) + [350] * 300
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r.v: r.n_before for r in cumulative_counts(counts, ["g"], "v", "n", 16).collect()}
    assert got == {v: sum(w < v for w in values) for v in set(values)}


def test_gate(spark, scores):
    broken = scores.filter("not (method = 'C' and dataset = 1)")
    assert {r.dataset for r in R.complete_datasets(broken).collect()} == {0}
    with pytest.raises(Exception, match="different numbers of scores"):
        R.complete_datasets(broken, strict=True).collect()
    assert {r.complete for r in R.completeness(broken).collect()} == {True, False}


def test_all_tables(scores):
    tables = compare_methods(scores)
    counts = {name: df.count() for name, df in tables.items()}
    assert counts == {
        "summary": 3, "ranks": 6, "mean_ranks": 3, "friedman": 1, "wilcoxon": 6, "z": 3,
        "hommel": 6, "shaffer": 3, "benjamini_hochberg": 6,
    }


def test_uneven_methods_raise(spark):
    rows = [(m, d, float(d)) for m in "ABC" for d in range(5)][:-1]
    scores = spark.createDataFrame(rows, "method string, dataset int, score double")
    for test in (C.friedman, C.rank_z):
        with pytest.raises(Exception, match="unequal numbers"):
            test(scores).collect()
