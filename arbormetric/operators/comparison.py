"""Multiple comparison of methods on score tables ``(method, dataset, score)``.

The score table may be long (one row per method and data set); everything after the first
aggregation has one row per pair of methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbormetric.functions.tails import f_upper_p_even, f_upper_p_odd, normal_two_sided_p
from arbormetric.operators.ordering import cumulative_counts
from arbormetric.operators.ranking import average_rank

EXACT_LIMIT = 30


def _rank_table(scores: DataFrame) -> DataFrame:
    """Mean rank per method with the number of data sets ``l`` and of methods ``s``.

    Methods with unequal numbers of data sets raise: their ranks do not compare.
    """
    ranks = average_rank(scores)
    means = ranks.groupBy("method").agg(
        F.avg("rank").alias("mean_rank"), F.count("*").alias("l")
    )
    methods = W.partitionBy(F.lit(0))  # One row per method.
    uneven = F.min("l").over(methods) != F.max("l").over(methods)
    refused = F.raise_error(F.lit("methods have unequal numbers of data sets")).cast("long")
    return means.withColumns(
        {"s": F.count("*").over(methods), "l": F.when(uneven, refused).otherwise(F.col("l"))}
    )


def friedman(scores: DataFrame) -> DataFrame:
    """One row ``(s, l, chi2, f, p)``."""
    table = _rank_table(scores).groupBy("s", "l").agg(
        F.sum(F.col("mean_rank") * F.col("mean_rank")).alias("ss")
    )
    s, l = F.col("s"), F.col("l")
    chi2 = (F.col("ss") - s * (s + 1) * (s + 1) / 4) * 12 * l / (s * (s + 1))
    tested = (
        table.withColumn("chi2", chi2)
        .withColumn("f", F.try_divide((l - 1) * F.col("chi2"), l * (s - 1) - F.col("chi2")))
        .withColumn("d1", s - 1)
        .withColumn("d2", (s - 1) * (l - 1))
    )
    even = f_upper_p_even(F.col("f"), F.col("d1"), F.col("d2"))
    odd = f_upper_p_odd(F.col("f"), F.col("d1").cast("double"), F.col("d2").cast("double"))
    # All rankings agree: the F value is infinite and its tail is empty.
    p = F.when(F.col("f").isNull(), 0.0).when(F.col("d1") % 2 == 0, even).otherwise(odd)
    return tested.select("s", "l", "chi2", "f", p.alias("p"))


def method_pairs(scores: DataFrame) -> DataFrame:
    """``(a, b, dataset, diff)`` for a before b, ``diff`` = score of b minus score of a.

    A data set's scores are one array, so the scores are read and shuffled once.
    """
    own = F.array_sort(F.collect_list(F.struct("method", "score")))

    def behind(x: Column, at: Column) -> Column:
        later = F.filter(F.slice("_own", at + 2, F.size("_own")), lambda y: y["method"] > x["method"])
        return F.transform(
            later,
            lambda y: F.struct(
                x["method"].alias("a"), y["method"].alias("b"), (y["score"] - x["score"]).alias("diff")
            ),
        )

    pairs = F.flatten(F.transform("_own", behind))
    return (
        scores.groupBy("dataset").agg(own.alias("_own"))
        .select("dataset", F.explode(pairs).alias("_p"))
        .select("_p.a", "_p.b", "dataset", "_p.diff")
    )


def signed_rank(pairs: DataFrame) -> DataFrame:
    """``(a, b, size, n, n_pos, rank)``: mean rank of every |difference| and how often it occurs."""
    counts = (
        pairs.withColumn("size", F.abs("diff"))
        .groupBy("a", "b", "size")
        .agg(F.count("*").alias("n"), F.sum((F.col("diff") > 0).cast("long")).alias("n_pos"))
    )
    return cumulative_counts(counts, ["a", "b"], "size", "n").select(
        "a", "b", "size", "n", "n_pos", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")
    )


def _subset_sum_tail(n: Column, least: Column) -> Column:
    """Share of the subsets of 1..n whose sum is at least ``least`` (n up to EXACT_LIMIT)."""
    top = n * (n + 1) / 2
    empty = F.transform(
        F.sequence(F.lit(0), top.cast("int")), lambda v: F.when(v == 0, 1.0).otherwise(0.0)
    )
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        empty,
        lambda table, rank: F.transform(
            table,
            lambda c, at: c + F.when(at >= rank, F.get(table, at - rank)).otherwise(0.0),
        ),
    )
    tail = F.aggregate(
        F.transform(counts, lambda c, at: F.when(at >= least, c).otherwise(0.0)),
        F.lit(0.0),
        lambda total, c: total + c,
    )
    return tail / F.pow(F.lit(2.0), n)


def wilcoxon_pairs(
    scores: DataFrame, both: bool = False, exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """Signed-rank test of every pair: ``(a, b, n, w_max, p)``.

    Exact up to ``exact_limit`` data sets (equal differences stay in the ranking and zeros count against the
    positive sum, so the exact value may exceed 1), else the normal approximation.
    """
    n, top = F.col("n"), F.col("n") * (F.col("n") + 1) / 2
    tested = (
        signed_rank(method_pairs(scores))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n_pos") * F.col("rank")).alias("w_plus"))
        .withColumn("w_max", F.greatest(F.col("w_plus"), top - F.col("w_plus")))
    )
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = (top - F.col("w_max") - n * (n + 1) / 4 - 0.5) / spread
    exact = 2 * _subset_sum_tail(F.least(n, F.lit(exact_limit)), F.col("w_max"))
    result = tested.select(
        "a",
        "b",
        "n",
        "w_max",
        F.when(n <= exact_limit, exact).otherwise(normal_two_sided_p(z)).alias("p"),
    )
    return both_orders(result) if both else result


def both_orders(pairs: DataFrame) -> DataFrame:
    """Add every pair in the opposite order."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    orders = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(orders).alias("_o"), *rest).select("_o.a", "_o.b", *rest)


def rank_z(scores: DataFrame) -> DataFrame:
    """``(a, b, z, p)``: normal test of the difference of two mean ranks."""
    table = _rank_table(scores)
    left = table.select(F.col("method").alias("a"), F.col("mean_rank").alias("ra"), "s", "l")
    right = table.select(F.col("method").alias("b"), F.col("mean_rank").alias("rb"), "l")
    z = F.abs(F.col("ra") - F.col("rb")) / F.sqrt(F.col("s") * (F.col("s") + 1) / 6 / F.col("l"))
    return (
        left.join(right, "l")
        .filter("a < b")
        .select("a", "b", z.alias("z"))
        .withColumn("p", normal_two_sided_p(F.col("z")))
    )


def _by_control(pvals: DataFrame) -> DataFrame:
    """``(control, other, p, i, n)``: i-th smallest p of a control."""
    w = W.partitionBy("control")
    return (
        both_orders(pvals.select("a", "b", "p"))
        .withColumnsRenamed({"a": "control", "b": "other"})
        .withColumn("i", F.row_number().over(w.orderBy("p", "other")))
        .withColumn("n", F.count("*").over(w))
    )


def hommel(pvals: DataFrame, control: str | None = None) -> DataFrame:
    """Hommel procedure for every method as control (or one): ``(control, other, p, adjusted)``.

    The adjusted value is J*p, J being the last j before the first with j*p above the bound of j.
    """
    ranked = _by_control(pvals)
    if control is not None:
        ranked = ranked.filter(F.col("control") == control)
    p, i, j, n = F.col("p"), F.col("i"), F.col("j"), F.col("n")
    bounds = (
        ranked.withColumn("j", F.explode(F.sequence(n - i + 1, n)))
        .groupBy("control", "j")
        .agg(F.min(j * p / (i + j - n)).alias("bound"))
    )
    stopped = (
        ranked.join(bounds, "control")
        .groupBy("control", "other", "p", "n")
        .agg(F.min(F.when(j * p > F.col("bound"), j)).alias("stop"))
    )
    last = F.coalesce(F.col("stop") - 1, n)
    return stopped.select("control", "other", "p", (last * p).alias("adjusted"))


def true_hypothesis_counts(methods: DataFrame) -> DataFrame:
    """``(k, t)``: possible numbers of true hypotheses among the pairs of k methods.

    ``methods`` has one row per method.  The set of k comes from those of the smaller k; each
    level is a short sorted array, so the whole table is one fold and not a loop of jobs.
    """
    top = methods.select(F.count("*").cast("int").alias("s"))
    level = F.array_sort(F.array(F.lit(0)))
    start = F.array(level, level)

    def extend(levels: Column, k: Column) -> Column:
        merged = F.flatten(
            F.transform(
                F.sequence(F.lit(1), k),
                lambda j: F.transform(
                    F.get(levels, k - j), lambda t: (j * (j - 1) / 2).cast("int") + t
                ),
            )
        )
        return F.concat(levels, F.array(F.array_sort(F.array_distinct(merged))))

    steps = F.when(F.col("s") >= 2, F.sequence(F.lit(2), F.greatest("s", F.lit(2)))).otherwise(
        F.array().cast("array<int>")
    )
    return top.select(F.posexplode(F.aggregate(steps, start, extend)).alias("k", "ts")).select(
        "k", F.explode("ts").alias("t")
    )


def shaffer(pvals: DataFrame) -> DataFrame:
    """Static Shaffer procedure: ``(a, b, p, adjusted)``."""
    pairs = pvals.select("a", "b", "p")
    methods = pairs.select(F.explode(F.array("a", "b")).alias("method")).distinct()
    s = methods.select(F.count("*")).scalar()
    n = pairs.select(F.count("*")).scalar()
    possible = true_hypothesis_counts(methods).filter(F.col("k") == s)
    counts = possible.select(F.collect_set("t")).scalar()
    # One row per pair of methods: the order over all of them is the procedure itself.
    everything = W.orderBy("p", "a", "b")
    ranked = (
        pairs.withColumn("i", F.row_number().over(everything) - 1)
        .withColumns({"_n": n, "_counts": counts})
        .withColumn(
            "t", F.array_max(F.filter("_counts", lambda t: t <= F.col("_n") - F.col("i")))
        )
    )
    running = F.max(F.col("t") * F.col("p")).over(everything.rowsBetween(W.unboundedPreceding, 0))
    return ranked.select("a", "b", "p", F.least(F.lit(1.0), running).alias("adjusted"))


def benjamini_hochberg(pvals: DataFrame) -> DataFrame:
    """False-discovery values per control: ``(control, other, p, q)``."""
    ranked = _by_control(pvals)
    down = (
        W.partitionBy("control")
        .orderBy(F.desc("p"), F.desc("other"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    scaled = F.col("p") * F.col("n") / F.col("i")
    return ranked.select(
        "control", "other", "p", F.least(F.lit(1.0), F.min(scaled).over(down)).alias("q")
    )
