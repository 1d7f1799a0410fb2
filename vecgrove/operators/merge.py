"""Merging clustered databases."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merge_databases(base: DataFrame, addition: DataFrame, mode: str = "full") -> DataFrame:
    """``full`` keeps all points; ``left`` only clusters of the base; ``inner`` only clusters of both."""
    if mode == "full":
        return base.unionByName(addition)
    if mode not in ("left", "inner"):
        raise ValueError(f"unknown mode {mode}")
    kept = addition.join(base.select("cluster_id").distinct(), "cluster_id", "left_semi")
    if mode == "inner":
        base = base.join(addition.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return base.unionByName(kept.select(base.columns))
