"""Edges: rows keyed (from, to)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbors(edges: DataFrame, node, source: str = "from", target: str = "to") -> DataFrame:
    return edges.where(F.col(source) == node).select(F.col(target).alias("neighbor"))


def step(frontier: DataFrame, edges: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Nodes one edge from the frontier (column id), once each."""
    return frontier.select(F.col("id").alias(source)).distinct().join(edges, source).select(F.col(target).alias("id")).distinct()
