"""Model selection over a parameter grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbormetric.functions.margin_fit import fit_margin
from arbormetric.operators.ordering import positions
from arbormetric.operators.polynomials import Range
from arbormetric.runtime import cut_lineage

# Labelled rows, in expectation, from which a classifier is fitted, and those of each class and fold
# that are drawn in any case, all of them where there are fewer.
FIT_ROWS = 2000
LEAST_ROWS = 50


def stratified_folds(labels: DataFrame, folds: int) -> DataFrame:
    """``(id, y, fold)``: the members of each class are dealt to the folds in id order."""
    checked = labels.filter(
        F.when(F.col("y").isin(1.0, -1.0), True).otherwise(
            F.raise_error(F.lit("labels must be 1 or -1")).cast("boolean")
        )
    )
    dealt = positions(checked.select("id", "y"), ["y"], "id")
    return dealt.select("id", "y", F.pmod("position", F.lit(folds)).cast("int").alias("fold"))


def grid_cv(
    gram: DataFrame, labels: DataFrame, logc: Range, folds: int = 5, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``(a_ix, b_ix, c_ix, alpha, beta, logc, id, y, predicted, converged)`` by k-fold
    cross-validation.

    A classifier is fitted per grid point and fold on at most about ``fit_rows`` labelled rows,
    drawn by a hash of the id where there are more, evenly but for LEAST_ROWS of each class and
    fold; every fold of a grid point is a task of its own.  Predictions cover all rows: a join with
    the fitted weights and a sum.  A Gram row without label, a label without Gram row, and a Gram
    table that lacks cells, raise.  ``converged`` is false as well where a fit saw one class only
    although the labels hold two.
    """
    if folds < 2:
        raise ValueError("fewer than two folds leave nothing to fit from")
    parts = cut_lineage(stratified_folds(labels, folds))
    values = [logc.low * (1.0 - s / logc.divisions) + logc.high * s / logc.divisions
              for s in range(logc.divisions + 1)] if logc.divisions else [logc.low]
    grid = list(dict.fromkeys(values))
    fitted = _drawn(parts, fit_rows)
    classes = parts.select("y").distinct().count()
    side = lambda end: fitted.select(F.col("id").alias(end), F.col("y").alias(f"y_{end}"), F.col("fold").alias(f"fold_{end}"))
    cells = (
        gram.join(side("i"), "i")
        .join(side("j").drop("y_j"), "j")
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .filter("fold <> fold_i AND fold <> fold_j")
        .select("a_ix", "b_ix", "fold", "i", "j", "v", "y_i")
    )
    item = gram.schema["i"].dataType.simpleString()
    schema = (
        f"a_ix int, b_ix int, fold int, j {item}, w array<double>, shift array<double>, n long, "
        "converged array<boolean>"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"])
        if len(pdf) != len(ids) ** 2 or not np.array_equal(ids, np.unique(pdf["j"])):
            raise ValueError("the Gram table of a grid point lacks cells or repeats them")
        i, j = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        kernel, y = np.zeros((len(ids), len(ids))), np.empty(len(ids))
        kernel[i, j], y[i] = pdf["v"], pdf["y_i"]
        fits = [fit_margin(kernel, y, 10.0**exponent) for exponent in grid]
        whole = len(np.unique(y)) == classes
        result = pd.DataFrame({"j": ids, "w": list(np.array([f[0] for f in fits]).T), "n": len(ids)})
        result["shift"] = [[f[1] for f in fits]] * len(ids)
        result["converged"] = [[bool(f[2] and whole) for f in fits]] * len(ids)
        for column in ("a_ix", "b_ix", "fold"):
            result[column] = pdf[column].iloc[0]
        return result[["a_ix", "b_ix", "fold", "j", "w", "shift", "n", "converged"]]

    weights = cells.groupBy("a_ix", "b_ix", "fold").applyInPandas(fit, schema)
    unlabelled = F.raise_error(F.lit("a Gram row has no label")).cast("int")
    held = gram.join(parts.withColumnsRenamed({"id": "i"}), "i", "left").withColumn("fold", F.coalesce("fold", unlabelled))
    lacking = F.raise_error(F.lit("the Gram table lacks cells")).cast("array<double>")
    # One join with the Gram table for all penalties, which are columns of the sum.
    sums = F.array(*[F.sum(F.col("w")[c] * F.col("v")) for c in range(len(grid))])
    values = F.when(F.count("*") != F.first("n"), lacking).otherwise(
        F.zip_with(sums, F.first("shift"), lambda total, shift: total + shift)
    )
    predictions = (
        held.join(weights, ["a_ix", "b_ix", "fold", "j"])
        .groupBy("a_ix", "b_ix", "alpha", "beta", F.col("i").alias("id"), "y")
        .agg(values.alias("values"), F.first("converged").alias("converged"))
        .withColumn("logc", F.array(*[F.lit(x) for x in grid]))
        .select("a_ix", "b_ix", "alpha", "beta", "id", "y",
                F.posexplode(F.arrays_zip("values", "converged", "logc")).alias("c_ix", "_at"))
        .select("a_ix", "b_ix", "c_ix", "alpha", "beta", "_at.logc", "id", "y",
                F.when(F.col("_at.values") > 0, 1.0).otherwise(-1.0).alias("predicted"), "_at.converged")
    )
    known = gram.filter("i = j").select(F.col("i").alias("id"), F.lit(False).alias("absent")).distinct()
    unknown = F.raise_error(F.lit("a label has no Gram row")).cast("boolean")
    absent = parts.join(known, "id", "left").filter(F.coalesce("absent", unknown)).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in predictions.schema]
    )
    return predictions.unionByName(absent)


def _drawn(parts: DataFrame, fit_rows: int) -> DataFrame:
    counts = parts.groupBy("y", "fold").agg(F.count("*").alias("n"))  # Two rows a fold.
    share = F.greatest(F.lit(fit_rows) / F.sum("n").over(W.partitionBy()), F.lit(LEAST_ROWS) / F.col("n"))
    shares = counts.select("y", "fold", F.least(share, F.lit(1.0)).alias("share"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    return parts.join(F.broadcast(shares), ["y", "fold"]).filter(drawn).select("id", "y", "fold")


def confusion(predictions: DataFrame) -> DataFrame:
    """``tp, fp, fn, tn`` of labels 1 and -1 per grid point, and whether all its fits ``converged``
    if the predictions tell."""
    known = [F.bool_and("converged").alias("converged")] if "converged" in predictions.columns else []
    y, p = F.col("y"), F.col("predicted")

    def count(label: int, answer: int):
        return F.sum(((y == label) & (p == answer)).cast("long"))

    return predictions.groupBy("a_ix", "b_ix", "c_ix", "alpha", "beta", "logc").agg(
        count(1, 1).alias("tp"),
        count(-1, 1).alias("fp"),
        count(1, -1).alias("fn"),
        count(-1, -1).alias("tn"),
        *known,
    )


def with_accuracy(outcomes: DataFrame) -> DataFrame:
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return outcomes.withColumns(
        {
            "error": F.col("fp") + F.col("fn"),
            "accuracy": F.try_divide((F.col("tp") + F.col("tn")).cast("double"), total),
        }
    )


def optimal_points(outcomes: DataFrame) -> DataFrame:
    """Every grid point with the least error."""
    scored = with_accuracy(outcomes)
    return scored.filter(F.col("error") == scored.select(F.min("error")).scalar())


def select_model(outcomes: DataFrame) -> DataFrame:
    """The first grid point with the least error."""
    return with_accuracy(outcomes).orderBy("error", "a_ix", "b_ix", "c_ix").limit(1)
