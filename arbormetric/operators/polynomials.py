"""Tables of bivariate polynomials ``(keys, ex, ey, coef)`` and what is built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbormetric.functions.polytext import coefficient, exponent, is_polynomial, signed_terms


def poly_terms(df: DataFrame, expr: str, keys: list[str]) -> DataFrame:
    """Text to terms; equal monomials of a text are added up, malformed texts are left out."""
    terms = df.filter(is_polynomial(F.col(expr))).select(
        *keys, F.explode(signed_terms(F.col(expr))).alias("_term")
    )
    term = F.col("_term")
    parsed = terms.select(
        *keys,
        exponent(term, "x").alias("ex"),
        exponent(term, "y").alias("ey"),
        coefficient(term).alias("coef"),
    )
    return poly_reduce(parsed, keys)


def poly_rejects(df: DataFrame, expr: str) -> DataFrame:
    return df.filter(~F.coalesce(is_polynomial(F.col(expr)), F.lit(False)))


def poly_reduce(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Add equal monomials and drop zeros; a polynomial without terms is the constant 0.

    The zero constant of every key is one more summand, which saves a second pass over the keys.
    """
    summed = terms.groupBy(*keys, "ex", "ey").agg(F.sum("coef").alias("coef"))
    per_key = summed.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("coef") != 0, F.struct("ex", "ey", "coef"))).alias("_terms")
    )
    constant = F.array(
        F.struct(F.lit(0).alias("ex"), F.lit(0).alias("ey"), F.lit(0.0).alias("coef"))
    )
    terms_or_zero = F.when(F.size("_terms") > 0, F.col("_terms")).otherwise(constant)
    return per_key.select(*keys, F.explode(terms_or_zero).alias("_t")).select(
        *keys, "_t.ex", "_t.ey", "_t.coef"
    )


def _combine(a: DataFrame, b: DataFrame, keys: list[str], sign: float) -> DataFrame:
    columns = [*keys, "ex", "ey"]
    other = b.select(*columns, (F.col("coef") * sign).alias("coef"))
    return poly_reduce(a.select(*columns, "coef").unionByName(other), keys)


def poly_add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _combine(a, b, keys, 1.0)


def poly_sub(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _combine(a, b, keys, -1.0)


def poly_mul(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    right = b.select(
        *keys, F.col("ex").alias("_ex"), F.col("ey").alias("_ey"), F.col("coef").alias("_coef")
    )
    products = a.join(right, keys).select(
        *keys,
        (F.col("ex") + F.col("_ex")).alias("ex"),
        (F.col("ey") + F.col("_ey")).alias("ey"),
        (F.col("coef") * F.col("_coef")).alias("coef"),
    )
    return poly_reduce(products, keys)


def _constant(x: float, terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.select(*keys).distinct().select(
        *keys, F.lit(0).alias("ex"), F.lit(0).alias("ey"), F.lit(float(x)).alias("coef")
    )


def poly_add_scalar(a: DataFrame, x: float, keys: list[str]) -> DataFrame:
    return poly_add(a, _constant(x, a, keys), keys)


def poly_scale(a: DataFrame, x: float, keys: list[str]) -> DataFrame:
    return poly_reduce(a.withColumn("coef", F.col("coef") * float(x)), keys)


def poly_format(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, text)``: monomials by descending exponents of x, then of y."""

    def power(name: str, e: Column) -> Column:
        return F.when(e == 0, "").when(e == 1, name).otherwise(
            F.concat(F.lit(name + "^"), e.cast("string"))
        )

    ordered = F.sort_array(F.collect_list(F.struct("ex", "ey", "coef")), asc=False)

    def piece(t: Column, at: Column) -> Column:
        sign = F.when(t["coef"] < 0, "-").when(at > 0, "+").otherwise("")
        return F.concat(
            sign, F.abs(t["coef"]).cast("string"), power("x", t["ex"]), power("y", t["ey"])
        )

    return (
        terms.groupBy(*keys)
        .agg(ordered.alias("_terms"))
        .select(*keys, F.array_join(F.transform("_terms", piece), "").alias("text"))
    )


@dataclass(frozen=True)
class Range:
    """Minimum, maximum and number of divisions of one parameter."""

    low: float
    high: float
    divisions: int


def div(low: Column, high: Column, divisions: Column, step: Column) -> Column:
    """The step-th of the equal divisions from low to high."""
    return low * (1.0 - step / divisions) + high * step / divisions


def with_ranges(df: DataFrame, **ranges: Range) -> DataFrame:
    """Add the limits of parameters ``a``, ``b``, ``c`` as columns."""
    columns = {}
    for name, r in ranges.items():
        columns[f"{name}_min"] = F.lit(float(r.low))
        columns[f"{name}_max"] = F.lit(float(r.high))
        columns[f"{name}_div"] = F.lit(int(r.divisions))
    return df.withColumns(columns)


def _values(name: str, first: int) -> Column:
    low, high, n = F.col(f"{name}_min"), F.col(f"{name}_max"), F.col(f"{name}_div")
    steps = F.sequence(F.lit(first), F.greatest(n.cast("int"), F.lit(1)))
    points = F.transform(steps, lambda step: div(low, high, n, step))
    # A range without divisions is its lower limit.
    return F.when(n < 1, F.array(low)).otherwise(F.array_distinct(points))


def kernel_grid(df: DataFrame) -> DataFrame:
    """Every row with every distinct ``(alpha, beta)``, alpha >= beta, and their places.

    alpha starts at step 1, beta at step 0.  The points are made from the limits in the row, so
    nothing is joined.
    """
    return (
        df.select("*", F.posexplode(_values("a", 1)).alias("a_ix", "alpha"))
        .select("*", F.posexplode(_values("b", 0)).alias("b_ix", "beta"))
        .filter("alpha >= beta")
        .drop("a_min", "a_max", "a_div", "b_min", "b_max", "b_div")
    )


def param_grid(df: DataFrame) -> DataFrame:
    """``kernel_grid`` with every distinct ``logc`` as well."""
    grid = kernel_grid(df).select("*", F.posexplode(_values("c", 0)).alias("c_ix", "logc"))
    return grid.drop("c_min", "c_max", "c_div")


def range_row(spark: SparkSession, **ranges: Range) -> DataFrame:
    return with_ranges(spark.range(1).drop("id"), **ranges)


def poly_eval(terms: DataFrame, alpha: Range, beta: Range) -> DataFrame:
    """``(i, j, a_ix, b_ix, alpha, beta, v)``: values of ``(i, j, ex, ey, coef)`` on the grid.

    The monomials of a pair are few, so they are gathered once and each grid point is a fold over
    them: only the terms are shuffled, not their copies per grid point.
    """
    gathered = terms.groupBy("i", "j").agg(
        F.array_sort(F.collect_list(F.struct("ex", "ey", "coef"))).alias("_terms")
    )
    value = F.aggregate(
        "_terms",
        F.lit(0.0),
        lambda total, t: total
        + t["coef"] * F.pow(F.col("alpha"), t["ex"]) * F.pow(F.col("beta"), t["ey"]),
    )
    return kernel_grid(with_ranges(gathered, a=alpha, b=beta)).select(
        "i", "j", "a_ix", "b_ix", "alpha", "beta", value.alias("v")
    )


def normalize_gram(gram: DataFrame) -> DataFrame:
    """Divide every value by the root of the product of its two diagonal values."""
    point = ["a_ix", "b_ix"]
    diagonal = gram.filter("i = j").select(*point, F.col("i").alias("_id"), F.col("v").alias("_v"))
    left = diagonal.withColumnsRenamed({"_id": "i", "_v": "_vi"})
    right = diagonal.withColumnsRenamed({"_id": "j", "_v": "_vj"})
    scale = F.sqrt(F.col("_vi") * F.col("_vj"))
    return (
        gram.join(left, [*point, "i"])
        .join(right, [*point, "j"])
        .withColumn("v", F.try_divide("v", scale))
        .select("i", "j", *point, "alpha", "beta", "v")
    )
