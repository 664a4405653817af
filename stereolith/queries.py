"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stereolith.plans import frame_queries, graph_queries, map_queries, match_queries
from stereolith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "entry", "frame_queries", "graph_queries", "map_queries", "match_queries"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored points of the final cloud."""
    return QUERIES["tr8_final_cloud_mask"](spark, sf_dir)
