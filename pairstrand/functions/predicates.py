"""Predicates on edges whose ends have true coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contained(ss: Column, se: Column, ds: Column, de: Column) -> Column:
    return ((ss <= ds) & (se >= de)) | ((ss >= ds) & (se <= de))


def is_correct_edge(ss: Column, se: Column, ds: Column, de: Column, strand: Column, tolerance: int = 0) -> Column:
    """Whether the destination begins inside the source, seen along the strand; false with any missing coordinate."""
    forward = (ss - tolerance < ds) & (ds < se + tolerance)
    backward = (ds - tolerance < ss) & (ss < de + tolerance)
    inside = F.when(strand == 1, forward).when(strand == -1, backward).otherwise(F.lit(False))
    return F.coalesce(~contained(ss, se, ds, de) & inside, F.lit(False))


def complete(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def edge_class(prefix_src: str = "s_", prefix_dst: str = "d_") -> Column:
    """Class of an edge with both ends' attributes: the first that holds of cross_chr, cross_strand, correct, forward_skip,
    backward_skip, unknown."""
    s, d = (lambda name: F.col(prefix_src + name)), (lambda name: F.col(prefix_dst + name))
    strand = s("read_strand")
    same = ((strand == 1) & (d("read_strand") == 1)) | ((strand == -1) & (d("read_strand") == -1))
    cols = {h: (s(f"read_start_{h}"), s(f"read_end_{h}"), d(f"read_start_{h}"), d(f"read_end_{h}")) for h in "MP"}
    correct = is_correct_edge(*cols["M"], strand) | is_correct_edge(*cols["P"], strand)
    full = {h: complete(*cols[h]) for h in "MP"}
    ss, se, ds, de = (F.when(full["M"], m).when(full["P"], p) for m, p in zip(cols["M"], cols["P"], strict=True))
    return (
        F.when(s("read_chr") != d("read_chr"), "cross_chr")
        .when(~F.coalesce(same, F.lit(False)), "cross_strand")
        .when(correct, "correct")
        .when(ss.isNull(), "unknown")
        .when((strand == 1) & (ds >= se), "forward_skip")
        .when((strand == 1) & (ds <= ss), "backward_skip")
        .when((strand == -1) & (ss >= de), "forward_skip")
        .when((strand == -1) & (ss <= ds), "backward_skip")
        .otherwise("unknown")
    )
