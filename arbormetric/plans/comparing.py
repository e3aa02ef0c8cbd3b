"""Scores to tests: every table of the multiple comparison in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arbormetric.operators import comparison as C
from arbormetric.operators import ranking as R
from arbormetric.runtime import cut_lineage


def compare_methods(
    scores: DataFrame, strict: bool = True, exact_limit: int = C.EXACT_LIMIT
) -> dict[str, DataFrame]:
    """Gate the scores, then ranks, Friedman, signed-rank, z, Hommel, Shaffer and BH tables."""
    gated = cut_lineage(R.complete_datasets(scores, strict=strict))
    ranks = R.average_rank(gated)
    wilcoxon = cut_lineage(C.wilcoxon_pairs(gated, exact_limit=exact_limit))
    z = cut_lineage(C.rank_z(gated))
    return {
        "summary": R.score_summary(gated),
        "ranks": ranks,
        "mean_ranks": R.mean_rank(ranks),
        "friedman": C.friedman(gated),
        "wilcoxon": C.both_orders(wilcoxon),
        "z": z,
        "hommel": C.hommel(z),
        "shaffer": C.shaffer(z),
        "benjamini_hochberg": C.benjamini_hochberg(wilcoxon),
    }
