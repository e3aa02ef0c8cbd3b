"""Kernel files (matrices of polynomials) and the outputs of a grid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.operators.polynomials import poly_rejects, poly_terms
from arbormetric.sources.lines import read_lines
from arbormetric.sources.matrices import LABEL, ROW


def _cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = read_lines(spark, paths).filter(F.col("line").rlike(ROW))
    cell = F.split(F.col("cell"), ":")
    return rows.select(
        F.regexp_extract("line", ROW, 1).cast("long").alias("i"),
        F.explode(F.split(F.trim(F.regexp_extract("line", ROW, 2)), r"\s+")).alias("cell"),
    ).select("i", cell[0].cast("long").alias("j"), cell[1].alias("expr"))


def read_kernel(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(id, y)`` from lines ``id:y`` and ``(i, j, ex, ey, coef)`` from lines ``i: j:poly ...``."""
    labels = read_lines(spark, paths).filter(F.col("line").rlike(LABEL)).select(
        F.regexp_extract("line", LABEL, 1).cast("long").alias("id"),
        F.regexp_extract("line", LABEL, 2).cast("double").alias("y"),
    )
    return labels, poly_terms(_cells(spark, paths), "expr", ["i", "j"])


def rejected_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(i, j, expr)`` of malformed polynomials."""
    return poly_rejects(_cells(spark, paths), "expr")


def write_grid_log(outcomes: DataFrame, path: str) -> None:
    columns = ["alpha", "beta", F.col("logc").alias("log C"), "tp", "fp", "fn", "tn"]
    ordered = outcomes.orderBy("a_ix", "b_ix", "c_ix")
    ordered.select(*columns).write.option("header", True).csv(path)


def write_best_model(result: dict[str, DataFrame], path: str) -> None:
    """Best point with its counts, labels, and the Gram table and diagonal of that point."""
    for name in ("best", "labels", "gram", "diagonal"):
        result[name].write.parquet(f"{path}/{name}")
