"""Joins that attach coordinates, flags and scores, and upserts of missing edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstrand.functions.strings import complement
from pairstrand.operators.graph import mirror

BIN = 65_536


def liftover(positions: DataFrame, chain: DataFrame, id_col: str, bin_size: int = BIN) -> DataFrame:
    """Positions with ``lifted``, their place in the other coordinates (null without a block; of several, the first block).

    positions: id, chr, position. chain: chr, t_start, t_end, q_start, and for blocks on the other strand q_strand '-' and
    q_size. A range join by bins: a block is copied to each bin that it reaches into, a position has one bin.
    """
    blocks = chain
    for name, default in (("q_strand", F.lit("+")), ("q_size", F.lit(None).cast("long"))):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, default)
    blocks = blocks.where("t_end > t_start").withColumn("bin", F.explode(F.sequence(F.expr(f"t_start div {bin_size}"), F.expr(f"(t_end - 1) div {bin_size}"))))
    rows = positions.withColumn("bin", F.expr(f"position div {bin_size}"))
    hits = rows.select(id_col, "chr", "position", "bin").join(blocks, ["chr", "bin"]).where("position >= t_start and position < t_end")
    along = F.col("q_start") + F.col("position") - F.col("t_start")
    lifted = F.when(F.col("q_strand") == "-", F.col("q_size") - 1 - along).otherwise(along)
    first = hits.groupBy(id_col).agg(F.min_by(lifted, F.struct("t_start", "q_start")).alias("lifted"))
    return positions.join(first, id_col, "left")


def final_edge_flag(edges: DataFrame, final: DataFrame, oriented: bool = True) -> DataFrame:
    """Edges with hifiasm_result: 1 if they, or their mirrors, are in the final assembly. Without ``oriented``, if their
    reads are neighbours there, on whatever strands."""
    if oriented:
        marks = final.select("src", "dst").union(mirror(final.select("src", "dst"))).distinct()
        return edges.join(marks.withColumn("hit", F.lit(1)), ["src", "dst"], "left").withColumn("hifiasm_result", F.coalesce("hit", F.lit(0))).drop("hit")
    pair = lambda: (F.least(F.expr("src div 2"), F.expr("dst div 2")).alias("a"), F.greatest(F.expr("src div 2"), F.expr("dst div 2")).alias("b"))
    marks = final.select(*pair()).distinct().withColumn("hit", F.lit(1))
    a, b = pair()
    return edges.withColumn("a", a).withColumn("b", b).join(marks, ["a", "b"], "left").withColumn("hifiasm_result", F.coalesce("hit", F.lit(0))).drop("hit", "a", "b")


def score_attach(edges: DataFrame, scores: DataFrame, default: float = 0.5) -> DataFrame:
    """Edges with scores; a default where none is known."""
    return edges.join(scores, ["src", "dst"], "left").fillna(default, ["score"])


def fan_out_scores(scores: DataFrame, key: str, value: str) -> DataFrame:
    """node, graphic_score: a pair's score for both of its nodes."""
    return scores.select(F.explode(F.array(2 * F.col(key), 2 * F.col(key) + 1)).alias("node"), F.col(value).alias("graphic_score"))


def sum_merge(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.unionByName(b).groupBy(key).agg(F.sum(value).alias(value))


def rescue(edges: DataFrame, nodes: DataFrame, placed: DataFrame, read_nodes: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add final-assembly edges that a graph lacks, and reads that it lacks: new nodes and edges (with hifiasm_result).

    placed: consecutive reads of final contigs (read_a, orient_a, read_b, orient_b, prefix); read_nodes: read_id, node (the
    forward node); lengths: read_id, read_length. Reads without a node get the next pairs of ids, in order of their ids;
    a minus orientation means the complement. Missing edges come with their mirrors; prefix lengths follow from lengths.
    """
    used = placed.select(F.explode(F.array("read_a", "read_b")).alias("read_id")).distinct()
    new = used.join(read_nodes, "read_id", "left_anti").join(lengths, "read_id")
    base = nodes.agg((F.expr("max(node) div 2") * 2 + 2).alias("base"))  # one row
    from pairstrand.operators.simplify import _numbered

    numbered = _numbered(new, "read_id").crossJoin(F.broadcast(base)).select("read_id", "read_length", (F.col("base") + 2 * F.col("number")).alias("node"))
    every = read_nodes.select("read_id", "node").unionByName(numbered.select("read_id", "node"))
    all_nodes = nodes.select("node", "read_length").unionByName(numbered.select(F.explode(F.array("node", complement(F.col("node")))).alias("node"), "read_length"))
    at = lambda end: every.select(F.col("read_id").alias(f"read_{end}"), F.col("node").alias(f"node_{end}"))
    turned = lambda end: F.when(F.col(f"orient_{end}") == "-", complement(F.col(f"node_{end}"))).otherwise(F.col(f"node_{end}"))
    wanted = placed.join(at("a"), "read_a").join(at("b"), "read_b").select(turned("a").alias("src"), turned("b").alias("dst"), "prefix")
    length = lambda end: all_nodes.select(F.col("node").alias(end), F.col("read_length").alias(f"len_{end}"))
    sized = wanted.join(length("src"), "src").join(length("dst"), "dst").withColumn("overlap_length", F.col("len_src") - F.col("prefix"))
    forward = sized.select("src", "dst", "overlap_length", F.col("prefix").alias("prefix_length"))
    back = sized.select(complement(F.col("dst")).alias("src"), complement(F.col("src")).alias("dst"), "overlap_length", (F.col("len_dst") - F.col("overlap_length")).alias("prefix_length"))
    final = forward.unionByName(back).dropDuplicates(["src", "dst"])
    flagged = final_edge_flag(edges.select("src", "dst", "overlap_length", "prefix_length"), final)
    missing = final.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hifiasm_result", F.lit(1))
    return numbered.select("read_id", "node", "read_length"), flagged.unionByName(missing)
