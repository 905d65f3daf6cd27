"""Connected components by joins: smallest labels travel along edges, then labels are followed to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.sources.shared import bucketed, forget, new_folder, shuffle_partitions, written


def wcc(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Weakly connected components of the nodes that have edges: node, component (the smallest node of each).

    Each round points every node to its smallest neighbour, if that is smaller than itself, and merges it into the node where such
    pointers end (``roots``: rounds follow the digits of the longest line of pointers). Edges go on between merged nodes, those
    within one are dropped, so rounds shrink, and no table of all nodes is written before the end. Minima aggregate before their
    shuffles, so a node with very many edges does no harm.
    """
    one_way = edges.select(edges[src].alias("u"), edges[dst].alias("v"))
    both = one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = rest = written(both.distinct(), "wcc-edges")
    merged: list[DataFrame] = []
    while merged == [] or not rest.isEmpty():
        pointers = rest.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up")).where("up < node")
        merged.append(written(roots(pointers), "wcc-merged"))
        end = lambda e: F.coalesce(f"root_{e}", e).alias(e)
        left = rest
        for e in ("u", "v"):
            left = left.join(merged[-1].select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")), e, "left")
        before, rest = rest, written(left.select(end("u"), end("v")).where("u <> v").distinct(), "wcc-edges")
        if before is not first:
            forget(before)
    # what later rounds merged, which is little, is followed first
    known = merged[-1]
    for own in reversed(merged[:-1]):
        later = known.select(F.col("node").alias("root"), F.col("root").alias("last"))
        known = own.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(known.join(own.select("node"), "node", "left_anti"))
    found = written(first.select(F.col("u").alias("node")).distinct().join(known, "node", "left").select("node", F.coalesce("root", "node").alias("component")), "wcc-labels")
    forget(first, rest, *merged)
    return found


def find_components(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """Components of at least ``min_size`` nodes, one of each pair of mirrors: node, component.

    Of a component and its mirror the one with the smaller least node is kept; a component that is its own mirror stays.
    """
    found = written(wcc(edges), "components")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("node").bitwiseXOR(F.lit(1))).alias("mirror"))
    kept = sizes.where((F.col("n") >= min_size) & (F.col("component") <= F.col("mirror"))).select("component")
    return found.join(kept, "component").select("node", "component")


def component_stats(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, n, total_length, min_length, max_length, avg_length."""
    length = F.col("read_length")
    return members.join(nodes.select("node", "read_length"), "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("total_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.round(F.avg(length), 6).alias("avg_length")
    )


def largest_component(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the component with the greatest total length (of equals, the smallest label)."""
    totals = members.join(nodes.select("node", "read_length"), "node").groupBy("component").agg(F.sum("read_length").alias("total"))
    best = totals.agg(F.max(F.struct("total", (-F.col("component")).alias("neg"))).alias("b")).select((-F.col("b.neg")).alias("component"))
    return members.join(F.broadcast(best), "component").select("node", "component")


def roots(pointers: DataFrame) -> DataFrame:
    """Where pointers (node, up) end: node, root (a node without a pointer). Nodes whose pointers run in a circle are left out.

    Pointer doubling: rounds follow the logarithm of the longest line of pointers.
    """
    first = written(pointers.select("node", "up"), "roots-first")
    state, n, rounds = first, first.count(), 0
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        after = written(state.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        rounds += 1
        moved = not after.where("moved").isEmpty()
        if state is not first:
            forget(state)
        state = after
        if not moved or 1 << rounds > n:
            return state.select("node", F.col("up").alias("root")).join(first.select(F.col("node").alias("root")), "root", "left_anti").select("node", "root")


def _merged_into_single(edges: DataFrame, one: str, other: str, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes with a single edge at their ``other`` side merged into the node at that edge's ``one`` side, whole trees at once.

    Returns the edges that are left (of merged nodes, those to the root they have become), node and root of the merged nodes,
    and whether some pointers run in a circle. Nodes in ``keep`` aren't merged.
    """
    single = edges.groupBy(F.col(other).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("up")).where("n = 1 and node <> up").select("node", "up")
    if keep is not None:
        single = single.join(keep.select("node"), "node", "left_anti")
    single = written(single, "merge-single")
    root = written(roots(single), "merge-roots")
    circle = not single.join(root, "node", "left_anti").isEmpty()
    left = edges.join(single.select(F.col("node").alias(other)), other, "left_anti")
    left = left.join(root.select(F.col("node").alias(one), "root"), one, "left").select(F.coalesce("root", one).alias(one), other)
    return written(left.select("src", "dst").distinct(), "merge-edges"), root, circle


def reachable(edges: DataFrame, starts: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Nodes that chains of edges reach from the starts, these included; with ``within``, by its nodes only.

    A node with one edge in is reached when its predecessor is, so whole trees of such nodes stand and fall with their roots. What is
    left is searched breadth-first, so rounds follow the nodes with several edges in on the longest shortest way.
    """
    if within is not None:
        edges = edges.join(within.select(F.col("node").alias("dst")), "dst", "left_semi")
    starts = written(starts.select("node").distinct(), "reach-starts")
    step, root, _ = _merged_into_single(written(edges.select("src", "dst").distinct(), "reach-edges"), "src", "dst", starts)
    # a start has no pointer, so it is its tree's root
    seen = written(reached(starts, step, []), "reach")
    return seen.union(root.join(seen.select(F.col("node").alias("root")), "root").select("node"))


def reached(starts: DataFrame, step: DataFrame, key: list[str]) -> DataFrame:
    """The nodes that edges (src, dst) lead to from starts (key, node), these included: key, node. A round writes what it adds."""
    spark, folder, rounds = starts.sparkSession, new_folder(starts.sparkSession, "reached"), 0
    starts = starts.select(*key, "node").distinct()
    starts.write.parquet(f"{folder}/n=0")
    front = spark.read.schema(starts.schema).parquet(f"{folder}/n=0")
    while not front.isEmpty():
        rounds += 1
        seen = spark.read.schema(starts.schema).parquet(folder).select(*key, "node")
        new = front.join(step, F.col("node") == F.col("src")).select(*key, F.col("dst").alias("node")).distinct().join(seen, [*key, "node"], "left_anti")
        new.write.parquet(f"{folder}/n={rounds}")
        front = spark.read.schema(starts.schema).parquet(f"{folder}/n={rounds}")
    return spark.read.schema(starts.schema).parquet(folder).select(*key, "node")


def reachable_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: for each start by itself what ``reachable`` finds from it."""
    return reached(starts.select(F.col("node").alias("start"), "node"), written(edges.select("src", "dst").distinct(), "reach-edges"), ["start"])


def is_dag(edges: DataFrame) -> bool:
    """Whether a graph has no cycle.

    A node with one edge in is merged into its predecessor, one with one edge out into its successor: that neither makes nor breaks
    a cycle. Whole trees of such nodes merge at once, so chains, bubbles and ladders vanish in a few rounds; nodes without
    edges in or out are peeled off. A pointer that runs in a circle, an edge from a node to itself, or a rest in which
    nothing can be peeled off is a cycle.
    """
    rest = written(edges.select("src", "dst").distinct(), "dag")
    n = rest.count()
    while n:
        for one, other in (("src", "dst"), ("dst", "src")):
            if not rest.where("src = dst").isEmpty():
                return False
            rest, _, circle = _merged_into_single(rest, one, other)
            if circle:
                return False
        if not rest.where("src = dst").isEmpty():
            return False
        inner = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before, rest = rest, written(inner.select("src", "dst"), "dag")
        left = before.count()
        n = rest.count()
        if n and n == left:
            return False
    return True


def comp_ways(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """A shortest way from each start (node) to its complement: node, d (its edges), path (array of nodes).

    Only starts whose complement lies in their own component search at all. Each does so from both ends, a step along the edges and
    a step against them in turn, until the two meet, so each looks at nodes within half the way. A round writes the nodes that it
    adds, each with the smallest node it was reached from, and ways are put together by pointer doubling; where both searches
    meet in several nodes, the smallest counts.
    """
    from pairstrand.operators.refine import traces

    spark, c = starts.sparkSession, F.col
    # edges are dealt by either end, so that rounds shuffle their fronts only
    one_way = bucketed(edges.select("src", "dst"), "dist-edges", ["src"], distinct=True)
    steps = {"ahead": one_way, "behind": bucketed(one_way, "dist-edges", ["dst"])}
    label = wcc(one_way)
    other = label.select(c("node").bitwiseXOR(F.lit(1)).alias("node"), c("component").alias("other"))
    hopeful = starts.select("node").distinct().join(label, "node").join(other, "node").where("component = other")
    first = written(hopeful.select(c("node").alias("start")), "dist-starts")
    folders = {side: new_folder(spark, f"dist-{side}") for side in ("ahead", "behind")}
    schema = "start long, at long, d int, up long"
    fronts = {}
    for side, at in (("ahead", c("start")), ("behind", c("start").bitwiseXOR(F.lit(1)))):
        first.select("start", at.alias("at"), F.lit(0).alias("d"), F.lit(None).cast("long").alias("up")).write.parquet(f"{folders[side]}/n=0")
        fronts[side] = spark.read.schema(schema).parquet(f"{folders[side]}/n=0")
    found, rounds = new_folder(spark, "dist-found"), 0
    while True:
        side, opposite = ("ahead", "behind") if rounds % 2 == 0 else ("behind", "ahead")
        one, two = ("src", "dst") if side == "ahead" else ("dst", "src")
        rounds += 1
        seen = spark.read.schema(schema).parquet(folders[side]).select("start", "at")
        new = fronts[side].join(steps[side], c("at") == c(one)).groupBy("start", c(two).alias("at")).agg(F.min("at").alias("up"))
        there = spark.read.schema(schema).parquet(folders[opposite]).select("start", "at", c("d").alias("d_there"))
        new = new.join(seen, ["start", "at"], "left_anti").join(there, ["start", "at"], "left").select("start", "at", F.lit((rounds + 1) // 2).cast("int").alias("d"), "up", "d_there")
        new.write.parquet(f"{folders[side]}/n={rounds}")
        new = spark.read.schema(f"{schema}, d_there int").parquet(f"{folders[side]}/n={rounds}")
        if new.isEmpty():  # what these starts reach holds no complement
            break
        met = new.where("d_there is not null").groupBy("start").agg(F.min(c("d") + c("d_there")).alias("d"), F.min("at").alias("meet"))
        met.write.parquet(f"{found}/n={rounds}")
        met = spark.read.parquet(f"{found}/n={rounds}").select("start")
        fronts = {side: new.drop("d_there").join(met, "start", "left_anti"), opposite: fronts[opposite].join(met, "start", "left_anti")}
        if fronts[opposite].isEmpty():
            break
    met = spark.read.schema("start long, d int, meet long").parquet(found) if rounds > 1 or not new.isEmpty() else None
    if met is None:
        return spark.createDataFrame([], "node long, d int, path array<bigint>")
    half = {}
    for side in folders:
        pointers = spark.read.schema(schema).parquet(folders[side]).where("up is not null").join(met.select("start"), "start").select("start", c("at").alias("node"), "up")
        half[side] = traces(pointers, met.select("start", c("meet").alias("node")), ["start"])
    places = half["ahead"].select("start", (-c("back")).alias("k"), "node").union(half["behind"].where("back > 0").select("start", "back", "node"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("k", "node"))), lambda x: x["node"])
    return met.select("start", "d").join(places.groupBy("start").agg(path.alias("path")), "start").select(c("start").alias("node"), "d", "path")


def comp_dist(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Length in edges of the shortest way from each node to its complement: node, comp_dist (-1 without a way)."""
    return nodes.select("node").join(comp_ways(nodes, edges).select("node", "d"), "node", "left").select("node", F.coalesce("d", F.lit(-1)).alias("comp_dist"))


def edge_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How often the shortest ways of all forward nodes to their complements use each edge or its mirror: src, dst, ec_count and
    ec_count_normal (each way counting one over its length), both over the number of nodes."""
    ways = comp_ways(nodes.where("node % 2 = 0"), edges)
    steps = ways.select("d", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.col("d")).alias("src"), F.slice("path", F.lit(2), F.col("d")).alias("dst"))).alias("x")).select("d", "x.src", "x.dst")
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    both = steps.union(steps.select("d", flip("dst"), flip("src")))
    used = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("d")).alias("s"))
    total = nodes.select("node").distinct().count()
    share = lambda c: F.coalesce(F.col(c) / max(total, 1), F.lit(0.0))
    return edges.select("src", "dst").distinct().join(used, ["src", "dst"], "left").select("src", "dst", share("n").alias("ec_count"), share("s").alias("ec_count_normal"))


def deadends(nodes: DataFrame, edges: DataFrame, start_column: str, end_column: str) -> DataFrame:
    """Nodes that lie on no way from a leftmost node to the node farthest to the right that it reaches: node.

    By sweeps: of the nodes left, the one that begins first is the start; what it reaches is taken out; the nodes on ways
    from it to the one that ends last count as good. Sweeps that reach at most two nodes, or that end before an earlier sweep
    did, count nothing.

    All sweeps run side by side: a node is taken out by the first of all nodes that reach it, so the least (begin, node)
    travels along the edges until nothing changes.
    """
    placed = written(nodes.select("node", F.col(start_column).alias("s"), F.col(end_column).alias("e")).dropna(), "dead")
    known = placed.select("node")
    inner = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    inner = written(inner, "dead-edges")
    sweeps = front = written(placed.select("node", F.struct("s", "node").alias("sweep")), "dead-sweeps")
    while not front.isEmpty():
        sent = front.join(inner, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("sweep").alias("sent"))
        after = sweeps.join(sent, F.col("node") == F.col("dst"), "left").select("node", F.least("sweep", "sent").alias("sweep"), F.coalesce(F.col("sent") < F.col("sweep"), F.lit(False)).alias("moved"))
        after = written(after, "dead-sweeps")
        sweeps, front = after.select("node", "sweep"), after.where("moved").select("node", "sweep")
    last = F.max(F.struct("e", (-F.col("node")).alias("neg")))
    tops = sweeps.join(placed, "node").groupBy("sweep").agg(F.count(F.lit(1)).alias("n"), last.alias("top")).where("n > 2")
    tops = written(tops.select("sweep", F.col("top.e").alias("e"), (-F.col("top.neg")).alias("node")), "dead-tops")
    starts = tops.join(_ends_later_before(tops), "sweep", "left_anti").select("node")
    of_src, of_dst = sweeps.select(F.col("node").alias("src"), F.col("sweep").alias("a")), sweeps.select(F.col("node").alias("dst"), F.col("sweep").alias("b"))
    back = inner.join(of_src, "src").join(of_dst, "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return nodes.select("node").join(reachable(back, starts), "node", "left_anti")


def _ends_later_before(tops: DataFrame) -> DataFrame:
    """Sweeps before which an earlier one ends later: sweep.

    Running maxima in ranges of the order, and the greatest of all ranges before: no task gets all sweeps.
    """
    dealt = tops.repartitionByRange(shuffle_partitions(tops.sparkSession), "sweep").withColumn("part", F.spark_partition_id())
    dealt = written(dealt.select("sweep", "e", "part"), "dead-order")
    best = dealt.groupBy("part").agg(F.max("e").alias("best"))
    before = best.alias("x").join(F.broadcast(best.alias("y")), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.max("y.best").alias("before"))
    own = F.max("e").over(Window.partitionBy("part").orderBy("sweep").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("own", own).join(before, "part").where(F.greatest("own", "before") > F.col("e")).select("sweep")


def partition_with_halo(nodes: DataFrame, edges: DataFrame, parts: int, hops: int = 1) -> DataFrame:
    """Deal pairs of nodes into parts, each with its neighbours within ``hops`` edges: part, node, own.

    Parts are ranges of node ids, which lie together where ids follow the genome.
    """
    low, high = nodes.agg(F.min("node"), F.max("node")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    own = nodes.select("node", F.least(F.lit(parts - 1), F.floor((F.col("node") - (low or 0)) / (2 * (width // 2 + width % 2)))).cast("int").alias("part"))
    either = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "next").distinct()
    held = own
    for _ in range(hops):
        held = held.union(held.join(either, "node").select(F.col("next").alias("node"), "part")).distinct()
    return held.join(own.withColumnRenamed("part", "home"), "node").select("part", "node", (F.col("home") == F.col("part")).alias("own"))
