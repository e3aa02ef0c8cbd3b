"""Distance matrix files.

A file is ``*** DATASET name``, ``*** LABELS``, lines ``id:class``, a line
``*** DISTANCES: SHAPE=. GAP=. FLOAT=. EXACT_MATCH=. WEIGHT=.`` and lines ``i: 0:d 1:d ...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.operators.pairs import symmetric
from arbormetric.operators.variants import Variant, target_name
from arbormetric.sources.lines import read_lines

# Line forms.
DATASET = r"^\*\*\* DATASET\s+(.*)$"
DISTANCES = r"^\*\*\* DISTANCES:\s*(.*)$"
LABEL = r"^(\d+):(\S.*)$"
ROW = r"^(\d+):\s+(.+)$"


def dm_header(spark: SparkSession, paths: str | list[str], legacy: bool = False) -> DataFrame:
    """``(path, dataset, shape, gap, float, exact, weight, target)``, one row per file."""
    lines = read_lines(spark, paths)
    found = lines.groupBy("path").agg(
        F.max(F.when(F.col("line").rlike(DATASET), F.regexp_extract("line", DATASET, 1))).alias(
            "dataset"
        ),
        F.max(
            F.when(F.col("line").rlike(DISTANCES), F.regexp_extract("line", DISTANCES, 1))
        ).alias("header"),
    )
    fields = found.withColumn("header", F.str_to_map("header", F.lit(r"\s+"), F.lit("=")))
    names = {"shape": "SHAPE", "gap": "GAP", "float": "FLOAT", "exact": "EXACT_MATCH"}
    parts = {name: F.try_element_at("header", F.lit(key)) for name, key in names.items()}
    weight = F.try_element_at("header", F.lit("WEIGHT")).cast("double")
    table = fields.withColumns({**parts, "weight": weight})
    name = target_name(
        F.col("shape"), F.col("gap"), F.col("float"), F.col("exact"), F.col("weight"), legacy
    )
    return table.select("path", "dataset", *parts, "weight", name.alias("target"))


def header_problems(headers: DataFrame) -> DataFrame:
    """``(path, problem)`` for missing fields, mixed data sets and repeated targets."""
    same = headers.groupBy("target").agg(F.count("*").alias("_n"))
    datasets = headers.select(F.count_distinct("dataset")).scalar()
    problem = (
        F.when(F.col("dataset").isNull(), "no dataset")
        .when(F.col("target").isNull(), "no target")
        .when(datasets > 1, "inconsistent dataset names")
        .when(F.col("_n") > 1, "duplicated target")
    )
    return (
        headers.join(same, "target", "left")
        .select("path", problem.alias("problem"))
        .filter("problem is not null")
    )


def read_dm(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(target, i, j, d)`` with i < j and ``(id, class)``; other lines are ignored.

    A pair may stand in either half of a file, or in both with one value.  Raises for the problems
    of ``header_problems``, for halves that disagree and for ids of several classes.
    """
    lines = read_lines(spark, paths).select("path", "line")
    headers = dm_header(spark, paths)
    problems = header_problems(headers).limit(10).collect()
    if problems:
        raise ValueError("; ".join(f"{r.path}: {r.problem}" for r in problems))
    headers = headers.select("path", "target")
    cell = F.split(F.col("cell"), ":")
    cells = (
        lines.filter(F.col("line").rlike(ROW))
        .select(
            "path",
            F.regexp_extract("line", ROW, 1).cast("long").alias("i"),
            F.explode(F.split(F.trim(F.regexp_extract("line", ROW, 2)), r"\s+")).alias("cell"),
        )
        .select("path", "i", cell[0].cast("long").alias("j"), cell[1].cast("double").alias("d"))
        .filter("i <> j")
        .groupBy("path", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg(_one_value("d", "a pair has several distances").alias("d"))
    )
    labels = lines.filter(F.col("line").rlike(LABEL)).select(
        "path",
        F.regexp_extract("line", LABEL, 1).cast("long").alias("id"),
        F.regexp_extract("line", LABEL, 2).alias("class"),
    )
    labels = labels.groupBy("id").agg(_one_value("class", "an id has several classes").alias("class"))
    return cells.join(headers, "path").select("target", "i", "j", "d"), labels


def _one_value(column: str, problem: str) -> Column:
    several = F.min(column) != F.max(column)
    return F.when(several, F.raise_error(F.lit(problem))).otherwise(F.min(column))


def write_distances(dist: DataFrame, path: str) -> None:
    """The long table, one folder per target."""
    dist.write.partitionBy("target").parquet(path)


def write_dm(
    dist: DataFrame, labels: DataFrame, path: str, dataset: str, variant: Variant
) -> None:
    """The full square of one target as text, in the order of the file form."""
    flags = ["t" if x else "f" for x in (variant.gap, variant.floating, variant.exact)]
    header = (
        f"*** DISTANCES: SHAPE={variant.shape} GAP={flags[0]} FLOAT={flags[1]} "
        f"EXACT_MATCH={flags[2]} WEIGHT={variant.weight:.2f}"
    )
    spark = dist.sparkSession
    fixed = spark.createDataFrame(
        [(0, 0, f"*** DATASET {dataset}"), (0, 1, "*** LABELS"), (2, 0, header)],
        "section int, id long, line string",
    )
    names = labels.select(
        F.lit(1).alias("section"), "id", F.concat(F.col("id"), F.lit(":"), "class").alias("line")
    )
    cell = F.concat(
        F.col("j"), F.lit(":"), F.when(F.col("i") == F.col("j"), "0").otherwise(F.col("d").cast("string"))
    )
    rows = (
        symmetric(dist.filter(F.col("target") == variant.target))
        .groupBy("i")
        .agg(F.array_sort(F.collect_list(F.struct("j", cell.alias("cell")))).alias("cells"))
        .select(
            F.lit(3).alias("section"),
            F.col("i").alias("id"),
            F.concat(F.col("i"), F.lit(": "), F.array_join("cells.cell", " ")).alias("line"),
        )
    )
    ordered = fixed.unionByName(names).unionByName(rows).orderBy("section", "id")
    ordered.select("line").write.text(path)
