"""Queries registered with the driver, grouped by area."""

from registry import clustering, comparison, distances, kernels, trees

MODULES = [comparison, trees, distances, clustering, kernels]
