"""Density-based clustering of points on Spark, and the relational operators around it."""

from densika.operators.components import connected_components
from densika.operators.dbscan import cluster
from densika.operators.metrics import similarity, summary
from densika.operators.neighbors import core_points, neighbor_counts, neighbor_lists, pairs

__all__ = ["cluster", "connected_components", "core_points", "neighbor_counts", "neighbor_lists", "pairs", "similarity", "summary"]
