"""Threshold cuts that stay consistent between strands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstrand.operators.graph import mirror, mirror_semi


def cut_threshold(edges: DataFrame, column: str, threshold: float, high_is_good: bool = False) -> DataFrame:
    """Edges up to a threshold of badness (or from a threshold of goodness). All nodes stay."""
    c = F.col(column)
    return edges.where(c >= threshold if high_is_good else c <= threshold)


def reduction(edges: DataFrame, column: str, threshold: float, high_is_good: bool = False, restore: bool = False) -> DataFrame:
    """Cut, then drop edges whose mirrors were cut; with ``restore`` bring back the cut mirrors of kept edges instead."""
    kept = cut_threshold(edges, column, threshold, high_is_good)
    if not restore:
        return mirror_semi(kept)
    wanted = mirror(kept.select("src", "dst")).union(kept.select("src", "dst")).distinct()
    return edges.join(wanted, ["src", "dst"], "left_semi")


def double_cut(edges: DataFrame, c_t: float = 0.5, c_b: float = 0.9) -> DataFrame:
    """By to_cut, then by score."""
    return reduction(reduction(edges, "to_cut", c_t), "score", c_b)


def hap_edge_filter(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Edges neither of whose ends is labelled -1."""
    good = nodes.where(F.col(column) != -1).select("node")
    return edges.join(good.withColumnRenamed("node", "src"), "src", "left_semi").join(good.withColumnRenamed("node", "dst"), "dst", "left_semi")


def flip_score(edges: DataFrame, column: str = "score") -> DataFrame:
    return edges.withColumn(column, 1 - F.col(column))
