"""Inputs of the registered queries, each derived from whole test tables.

Scores are sums of integer hundredths over counts, so they do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.operators.pairs import all_pairs
from arbormetric.runtime import cut_lineage


#: Orders in one task of their join with lines.
TASK_ORDERS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def scores(spark: SparkSession, sf_dir: str, dataset) -> DataFrame:
    """Mean value of every event type (the method) per data set."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("method"), dataset.alias("dataset"))
        .agg((F.sum(cents("value")) / (F.count("*") * F.lit(100.0))).alias("score"))
    )


def scores_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd"))


def scores_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, F.col("user_id"))


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per order: status, its return flags, the line statuses of each flag.

    A tree has at most ten nodes however many lines an order has: the kinds of lines are bits that
    are combined, and nothing is collected. Both sides are dealt out once, to as many tasks as
    the orders ask for.
    """
    orders = table(spark, sf_dir, "orders")
    tasks = 1 + orders.count() // TASK_ORDERS
    flags, statuses = "ANR", "FO"
    place = (F.instr(F.lit(flags), F.col("l_returnflag")) - 1) * 2 + (
        F.instr(F.lit(statuses), F.col("l_linestatus")) - 1
    )
    kinds = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.call_function("shiftleft", F.lit(1), place).alias("kind"))
        .repartition(tasks, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.bit_or("kind").alias("kinds"))
    )

    def has(at: int):
        return F.col("kinds").bitwiseAND(F.lit(1 << at)) != 0

    below = []
    for n, flag in enumerate(flags):
        leaves = [F.when(has(2 * n + k), status) for k, status in enumerate(statuses)]
        child = F.concat(F.lit(f"{flag}("), F.concat_ws(", ", *leaves), F.lit(")"))
        below.append(F.when(has(2 * n) | has(2 * n + 1), child))
    return (
        orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
        .repartition(tasks, "o_orderkey")
        .join(kinds, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("tree_id"),
            F.col("o_orderpriority").alias("class"),
            F.concat("o_orderstatus", F.lit(" ("), F.concat_ws(" ", *below), F.lit(")")).alias(
                "tree"
            ),
        )
    )


def nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per nation: market segments by orders, and below each its priorities."""
    counts = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment", F.substring("o_orderpriority", 1, 1).alias("p"))
        .agg(F.count("*").alias("n"))
    )
    # At most 25 rows per nation from here on.
    segments = counts.groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "p"))).alias("ps"),
    )
    leaves = F.transform("ps", lambda x: x["p"])
    child = F.concat("c_mktsegment", F.lit("("), F.array_join(leaves, ","), F.lit(")"))
    trees = segments.groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), child.alias("t"))))
        .alias("children")
    )
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return trees.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").cast("long").alias("tree_id"),
        F.col("r_name").alias("class"),
        F.concat(
            F.lit("N("), F.array_join(F.transform("children", lambda c: c["t"]), ","), F.lit(")")
        ).alias("tree"),
    )


def brand_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(target, i, j, d)`` between brands by mean quantity, discount and tax per flag and status.

    All lines go into 25 profiles per target; means are exact sums over counts.
    """
    brand = F.substring_index("p_brand", "#", -1).cast("long")
    profiles = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("target"), brand.alias("id"))
        .agg(
            (F.sum(F.col("l_quantity").cast("long")) / (F.count("*") * F.lit(1.0))).alias("x"),
            (F.sum(cents("l_discount")) / (F.count("*") * F.lit(1.0))).alias("y"),
            (F.sum(cents("l_tax")) / (F.count("*") * F.lit(1.0))).alias("z"),
        )
    )
    a = profiles.withColumnsRenamed({"id": "i", "x": "xi", "y": "yi", "z": "zi"})
    b = profiles.withColumnsRenamed({"id": "j", "x": "xj", "y": "yj", "z": "zj"})

    def square(c: str):
        gap = F.col(f"{c}i") - F.col(f"{c}j")
        return gap * gap

    return (
        a.join(b, "target")
        .filter("i < j")
        .select("target", "i", "j", F.sqrt(square("x") + square("y") + square("z")).alias("d"))
    )


def brand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a brand: its most frequent part type."""
    brand = F.substring_index("p_brand", "#", -1).cast("long")
    counts = (
        table(spark, sf_dir, "part").groupBy(brand.alias("id"), "p_type").agg(F.count("*").alias("n"))
    )
    return counts.groupBy("id").agg(
        F.min(F.struct((-F.col("n")).alias("order"), "p_type"))["p_type"].alias("class")
    )


def order_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flat clusterings of all orders (by status, by month and by price) and their priorities."""
    orders = table(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice") / 50000)
    ways = F.array(
        F.struct(F.lit("status").alias("target"), F.lit(3).alias("k"),
                 F.col("o_orderstatus").alias("cluster")),
        F.struct(F.lit("month").alias("target"), F.lit(12).alias("k"),
                 F.month("o_orderdate").cast("string").alias("cluster")),
        F.struct(F.lit("price").alias("target"), F.lit(10).alias("k"),
                 price.cast("string").alias("cluster")),
    )
    assigned = orders.select(F.col("o_orderkey").alias("id"), F.explode(ways).alias("w")).select(
        "w.target", "w.k", "id", "w.cluster"
    )
    classes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"))
    return assigned, classes


def part_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polynomial texts per part; some of the first are malformed."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    first = F.concat(
        size, F.lit("*x^2*y-"), (F.col("p_size") % 7).cast("string"), F.lit("y^"),
        (key % 3 + 1).cast("string"), F.lit("x+y-2.5*y+3"),
    )
    return part.select(
        key.alias("id"),
        F.when(key % 10 == 0, F.concat(first, F.lit("*x*x"))).otherwise(first).alias("p"),
        F.concat(F.lit("-"), size, F.lit("x^2y+1.5*y-0.25")).alias("q"),
    )


def segment_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, y, p1..p5, s1..s3, w)``: one item per nation and market segment, 125 in all."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    place = F.array_position(F.array(*[F.lit(x) for x in segments]), F.col("c_mktsegment"))

    def share(condition):
        return F.sum(condition.cast("long")) / (F.count("*") * F.lit(1.0))

    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", (F.col("c_nationkey") * 5 + place).cast("long").alias("id"))
        .agg(
            *[
                share(F.substring("o_orderpriority", 1, 1) == str(n)).alias(f"p{n}")
                for n in range(1, 6)
            ],
            *[share(F.col("o_orderstatus") == s).alias(f"s{n}") for n, s in enumerate("FOP", 1)],
            share(cents("o_totalprice") > 25000000).alias("w"),
        )
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("y", F.when(F.col("n_regionkey") < 2, 1.0).otherwise(-1.0))
        .drop("c_nationkey", *nation.columns)
    )


def segment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel terms ``(i, j, ex, ey, coef)`` with i <= j: x by priorities, y by statuses, 1 by price."""
    items = cut_lineage(segment_profiles(spark, sf_dir))
    ids = items.select("id")
    pairs = all_pairs(ids, "id").unionByName(
        ids.select(F.col("id").alias("i"), F.col("id").alias("j"))
    )
    features = [c for c in items.columns if c not in ("id", "y")]
    a = items.select(F.col("id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in features])
    b = items.select(F.col("id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in features])

    def dot(names):
        total = F.lit(0.0)
        for c in names:
            total = total + F.col(f"a_{c}") * F.col(f"b_{c}")
        return total

    terms = F.array(
        F.struct(F.lit(1).alias("ex"), F.lit(0).alias("ey"),
                 dot([f"p{n}" for n in range(1, 6)]).alias("coef")),
        F.struct(F.lit(0).alias("ex"), F.lit(1).alias("ey"),
                 dot(["s1", "s2", "s3"]).alias("coef")),
        F.struct(F.lit(0).alias("ex"), F.lit(0).alias("ey"), dot(["w"]).alias("coef")),
    )
    return (
        pairs.join(a, "i").join(b, "j").select("i", "j", F.explode(terms).alias("t"))
        .select("i", "j", "t.ex", "t.ey", "t.coef")
    )


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_profiles(spark, sf_dir).select("id", "y")
