"""Bidirected graphs as two tables: nodes (node, ...) and edges (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstrand.functions.strings import complement
from pairstrand.sources.shared import written


def mirror(edges: DataFrame) -> DataFrame:
    """Each edge as it reads on the other strand, with its other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(complement(F.col("dst")).alias("src"), complement(F.col("src")).alias("dst"), *rest)


def reverse_graph(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def canonical(edges: DataFrame) -> DataFrame:
    """One edge of each pair of mirrors: the one that sorts first."""
    return edges.where(F.struct("src", "dst") <= F.struct(complement(F.col("dst")).alias("src"), complement(F.col("src")).alias("dst")))


def attach_endpoint_attrs(edges: DataFrame, nodes: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Edges with node columns of both ends, as s_<column> and d_<column>."""
    of = lambda end, p: nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return edges.join(of("src", "s"), "src", how).join(of("dst", "d"), "dst", how)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg (0 without edges)."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_deg"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_deg"))
    zero = F.lit(0).cast("long")
    return nodes.select("node").join(ins, "node", "left").join(outs, "node", "left").select("node", F.coalesce("in_deg", zero).alias("in_deg"), F.coalesce("out_deg", zero).alias("out_deg"))


def mirror_semi(edges: DataFrame) -> DataFrame:
    """Edges whose mirrors are there too."""
    return edges.join(mirror(edges.select("src", "dst")), ["src", "dst"], "left_semi")


def mirror_anti(edges: DataFrame) -> DataFrame:
    """Edges whose mirrors are missing."""
    return edges.join(mirror(edges.select("src", "dst")), ["src", "dst"], "left_anti")


def missing_complements(nodes: DataFrame) -> DataFrame:
    """Nodes whose complements are missing."""
    return nodes.join(nodes.select(complement(F.col("node")).alias("node")), "node", "left_anti")


def edge_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    known = nodes.select("node")
    no_src = edges.join(known.withColumnRenamed("node", "src"), "src", "left_anti")
    no_dst = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return no_src.select("src", "dst").union(no_dst.select("src", "dst")).distinct()


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    known = nodes.select("node")
    return edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")


def successors(edges: DataFrame) -> DataFrame:
    """Adjacency lists: node, successors (ascending)."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))


def two_steps(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Ways of two edges beside each edge: the edge with its columns, via, and the columns of both steps as first_* and second_*.

    An edge looks at the edges out of its source or at those into its destination, whichever are fewer, and then for the edge
    that closes the way. So a node with very many edges doesn't meet all pairs of them.
    """
    outs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outs"))
    ins = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("ins"))
    sized = edges.select("src", "dst", *columns).join(outs, "src").join(ins, "dst")
    first = edges.select("src", F.col("dst").alias("via"), *(F.col(c).alias(f"first_{c}") for c in columns))
    second = edges.select(F.col("src").alias("via"), "dst", *(F.col(c).alias(f"second_{c}") for c in columns))
    ahead = sized.where("outs <= ins").join(first, "src").join(second, ["via", "dst"])
    behind = sized.where("outs > ins").join(second, "dst").join(first, ["src", "via"])
    return ahead.unionByName(behind).drop("outs", "ins")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """Nodes between the ends of each edge: src, dst, via."""
    return two_steps(edges, []).select("src", "dst", "via")


def tips(edges: DataFrame) -> DataFrame:
    """Nodes with out-edges and without in-edges: node."""
    ends = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node")).distinct().join(ends, "node", "left_anti")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Seeds, all nodes within ``hops`` edges of them in either direction, and the complements of all these."""
    either = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).toDF("node", "next").distinct()
    reached = seeds.select("node").distinct()
    for _ in range(hops):
        reached = reached.union(reached.join(either, "node").select(F.col("next").alias("node"))).distinct()
    return reached.union(reached.select(complement(F.col("node")).alias("node"))).distinct()


def neighbourhoods(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node: for each seed by itself what ``neighbourhood`` finds from it.

    Nodes send lists of neighbours. All lists of a seed meet once, where they lose what is double and get their complements, so
    pairs are never shuffled by themselves.
    """
    ends = F.array(F.struct("src", F.col("dst").alias("next")), F.struct(F.col("dst").alias("src"), F.col("src").alias("next")))
    lists = edges.select(F.inline(ends)).groupBy(F.col("src").alias("node")).agg(F.collect_set("next").alias("near"))
    lists = written(lists, "near-lists")
    together = lambda found: found.groupBy("seed").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    front = own = seeds.select(F.col("node").alias("seed"), "node").distinct()
    every = own.select("seed", F.array("node").alias("near"))
    for hop in range(hops):
        found = front.join(lists, "node").select("seed", "near")
        every = every.union(found)
        if hop + 1 < hops:
            front = (together(found) if hop else found).select("seed", F.explode("near").alias("node"))
    both = F.array_distinct(F.flatten(F.transform("near", lambda x: F.array(x, complement(x)))))
    return together(every).select("seed", F.explode(both).alias("node"))


def neighbours_shared_by_edge(edges: DataFrame) -> DataFrame:
    """src, dst, node: for each edge by itself what ``shared_neighbours`` finds from it."""
    each = edges.select("src", "dst").distinct()
    between = common_neighbours(each)
    own = each.select("src", "dst", F.explode(F.array("src", "dst")).alias("node"))
    reached = own.union(between.select("src", "dst", "via"))
    return reached.union(reached.select("src", "dst", complement(F.col("node")))).distinct()


def shared_neighbours(edges: DataFrame, walk: DataFrame) -> DataFrame:
    """Nodes of a walk's edges (src, dst), those between their ends, and the complements of all these."""
    between = edges.select("src", F.col("dst").alias("via")).join(walk.select("src", "dst"), "src")
    between = between.join(edges.select(F.col("src").alias("via"), "dst"), ["via", "dst"]).select(F.col("via").alias("node"))
    own = walk.select(F.explode(F.array("src", "dst")).alias("node"))
    reached = own.union(between).distinct()
    return reached.union(reached.select(complement(F.col("node")).alias("node"))).distinct()


def assert_invariants(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise unless ends are nodes, nodes have complements and edges have mirrors."""
    for what, bad in (("edges without nodes", edge_integrity(nodes, edges)), ("nodes without complement", missing_complements(nodes)), ("edges without mirror", mirror_anti(edges))):
        if found := bad.take(3):
            raise ValueError(f"{what}: {found}")
