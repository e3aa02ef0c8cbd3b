"""Exact top-k inner products by a three-phase uniform threshold over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbormetric.llm.tables import stored, table

CANDIDATES = 2048
QUERIES = 1024


def integer_vector(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null where a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _scores(queries: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    a, b = np.array(queries["part"].tolist(), np.int64), np.array(rows["part"].tolist(), np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    # Doubles hold the sums exactly up to 2^53, and their product is the fast one.
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2**53 else a @ b.T


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p, F.lit(0)))


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int = 2,
    candidates_per_task: int = CANDIDATES, queries_per_task: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query in
    ``queries(vec_id, v)`` with the rows of ``vectors(vec_id, v)``, ``v`` arrays of long.

    Rows with the query's own id do not compete; ties go to the smaller id. Rows with a null
    vector or id take no part, shorter vectors count as filled up with zeros, a repeated query
    counts once and a repeated row as often as it stands.

    The dimensions are cut into ``blocks`` local lists, and a grid of query blocks and candidate
    blocks bounds what a task holds. Phase one gathers the ``k`` best of every local list and
    scores them in full, which gives each query a safe cutoff c: a row that reaches c has at least
    c / blocks in some list. Phase two sends each task its queries' cutoffs and collects
    the entries that reach their share. Phase three drops rows that the parts seen cannot
    lift to the best known k-th score, resolves the rest exactly and ranks them.
    """
    # Rows that share an id are told apart by their vectors.
    vectors = vectors.filter("vec_id is not null and v is not null").select("vec_id", "v", F.xxhash64("v").alias("row"))
    queries = (queries.filter("vec_id is not null and v is not null")
               .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    width = max(1, -(-size.d // blocks))
    rows_in = max(1, -(-size.n // candidates_per_task))
    queries_in = max(1, -(-queries.count() // queries_per_task))
    zeros = F.array_repeat(F.lit(0).cast("long"), blocks * width)

    def cut(df: DataFrame) -> DataFrame:
        full = F.slice(F.concat("v", zeros), 1, blocks * width)
        parts = F.array(*(F.struct(F.lit(b).alias("block"), F.slice(full, b * width + 1, width).alias("part")) for b in range(blocks)))
        return df.withColumn("cut", F.explode(parts)).select(*(c for c in df.columns if c != "v"), "cut.*")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = ["block", "rows_of", "queries_of"]
    rows = cut(vectors.withColumn("rows_of", F.pmod(F.monotonically_increasing_id(), F.lit(rows_in)).cast("int"))).withColumn(
        "queries_of", every(queries_in)).groupBy(*grid)
    asked = cut(queries.withColumn("queries_of", F.pmod(F.xxhash64("query_id"), F.lit(queries_in)).cast("int"))).withColumn("rows_of", every(rows_in))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({c: [] for c in names})
        score, ids = _scores(q, c), c["vec_id"].to_numpy()
        own = q["query_id"].to_numpy()[:, None] == ids
        n = min(k, len(c))
        at = np.argpartition(np.where(own, np.iinfo(np.int64).min, score), len(c) - n, axis=1)[:, len(c) - n :]
        who = np.repeat(np.arange(len(q)), n)
        keep = ~own[who, at.ravel()]
        who, at = who[keep], at.ravel()[keep]
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[who], "block": int(q["block"].iloc[0]), "vec_id": ids[at], "row": c["row"].to_numpy()[at], "score": score[who, at]})

    def reaching(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({c: [] for c in names})
        score, ids = _scores(q, c), c["vec_id"].to_numpy()
        share = np.array([-np.inf if x is None or x != x else x for x in q["cutoff"]], float) / blocks
        who, at = np.nonzero((score >= np.floor(share)[:, None]) & (q["query_id"].to_numpy()[:, None] != ids))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[who], "block": int(q["block"].iloc[0]), "vec_id": ids[at], "row": c["row"].to_numpy()[at], "score": score[who, at]})

    names = ["query_id", "block", "vec_id", "row", "score"]
    entry = "query_id long, block int, vec_id long, row long, score long"
    ranked = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")

    def resolved(pairs: DataFrame) -> DataFrame:
        return (pairs.join(vectors, ["vec_id", "row"]).join(queries.withColumnRenamed("v", "w"), "query_id")
                .select("query_id", "vec_id", _dot(F.col("v"), F.col("w")).alias("score")))

    lists = asked.groupBy(*grid).cogroup(rows).applyInPandas(best, entry)
    lists = lists.withColumn("place", F.row_number().over(ranked("query_id", "block"))).filter(F.col("place") <= k)
    known = resolved(lists.select("query_id", "vec_id", "row").distinct())
    cutoffs = stored(known.withColumn("place", F.row_number().over(ranked("query_id"))).filter(F.col("place") == k)
                     .select("query_id", F.col("score").alias("cutoff")))
    entries = asked.join(cutoffs, "query_id", "left").groupBy(*grid).cogroup(rows).applyInPandas(reaching, entry)
    # Equal rows have an entry each; sums are kept for rows seen once in every block, and all
    # others are looked up.
    sums = stored(entries.groupBy("query_id", "vec_id", "row").agg(
        F.sum("score").alias("seen"), F.count("*").alias("parts"), F.count_distinct("block").alias("lists")))
    whole = sums.filter((F.col("parts") == blocks) & (F.col("lists") == blocks)).select("query_id", "vec_id", F.col("seen").alias("score"))
    second = (whole.withColumn("place", F.row_number().over(ranked("query_id"))).filter(F.col("place") == k)
              .select("query_id", F.col("score").alias("second")))
    open_pairs = sums.filter((F.col("parts") != blocks) | (F.col("lists") != blocks)).join(cutoffs, "query_id", "left").join(second, "query_id", "left")
    most = F.col("seen") + (blocks - F.col("lists")) * F.ceil(F.col("cutoff") / blocks)
    hopeless = (F.col("parts") < blocks) & (F.col("parts") == F.col("lists")) & (most < F.greatest("cutoff", "second"))
    rest = resolved(open_pairs.filter(~F.coalesce(hopeless, F.lit(False))).select("query_id", "vec_id", "row"))
    return (whole.union(rest).withColumn("rank", F.row_number().over(ranked("query_id"))).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("v"))
    return exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
"""
