"""Kernel terms and labels to the best model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arbormetric.operators.polynomials import Range, normalize_gram, poly_eval
from arbormetric.operators.search import confusion, grid_cv, optimal_points, select_model
from arbormetric.runtime import cut_lineage


def search_kernel(
    terms: DataFrame,
    labels: DataFrame,
    alpha: Range = Range(0.0, 1.0, 4),
    beta: Range = Range(0.0, 1.0, 4),
    logc: Range = Range(-3.0, 3.0, 4),
    folds: int = 5,
    norm: bool = False,
) -> dict[str, DataFrame]:
    """Evaluate, normalise, cross-validate and select; ``gram`` is that of the best point."""
    gram = poly_eval(terms, alpha, beta)
    if norm:
        gram = normalize_gram(gram)
    gram = cut_lineage(gram)
    outcomes = cut_lineage(confusion(grid_cv(gram, labels, logc, folds)))
    best = select_model(outcomes)
    return {
        "outcomes": outcomes,
        "best": best,
        "optimal": optimal_points(outcomes),
        "gram": gram.join(best.select("a_ix", "b_ix"), ["a_ix", "b_ix"], "left_semi"),
        "diagonal": gram.filter("i = j").join(
            best.select("a_ix", "b_ix"), ["a_ix", "b_ix"], "left_semi"
        ),
        "labels": labels,
    }
