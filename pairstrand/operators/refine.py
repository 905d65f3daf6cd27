"""Walks rerouted by lightest ways: fewer bases of the wrong haplotype between the same ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.functions.strings import complement
from pairstrand.operators.components import reached
from pairstrand.operators.decode import beam_search, search_graph
from pairstrand.operators.metrics import WALK, trim_ends, wrong_runs
from pairstrand.sources.formats import running
from pairstrand.sources.shared import forget, new_folder, written


def lightest_ways(edges: DataFrame, ways: DataFrame, key: list[str]) -> DataFrame:
    """The lightest way of each pair of ends: key, cost, path (array of nodes); pairs that nothing joins give no row, nor do those
    from whose start a cycle of negative weight is reached.

    edges: src, dst, weight (whole numbers, of any sign). ways: key, start, end. All searches go on together: a node whose cost
    has become less sends it along its edges, until none becomes less. A round writes only what has become less, each with the
    node before it; paths are put together at the end. Of equally light ways the one of fewer nodes is kept, then that of
    smaller nodes before. With negative weights, pointers to the nodes before are followed now and then: where they run in
    a circle, a cycle of negative weight has been found, and its search ends.
    """
    spark, folder, rounds = edges.sparkSession, new_folder(edges.sparkSession, "ways"), 0
    step = written(edges.groupBy("src", "dst").agg(F.min("weight").cast("long").alias("weight")), "ways-edges")
    negative = not step.where("weight < 0").isEmpty()
    first = ways.select(*key, F.col("start").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("long").alias("up"))
    first.distinct().write.parquet(f"{folder}/n=0")
    schema = first.schema
    front = spark.read.schema(schema).parquet(f"{folder}/n=0")
    least = F.min(F.struct("cost", "hops", F.coalesce("up", F.lit(-1)).alias("up"))).alias("b")
    endless: DataFrame | None = None
    while True:
        known = spark.read.schema(schema).parquet(folder).groupBy(*key, "node").agg(least).select(*key, "node", F.col("b.cost").alias("known_cost"), F.col("b.hops").alias("known_hops"))
        sent = front.join(step, F.col("node") == F.col("src")).select(*key, F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("up"))
        best = sent.groupBy(*key, "node").agg(least).select(*key, "node", "b.cost", "b.hops", F.nullif("b.up", F.lit(-1)).alias("up"))
        less = F.col("known_cost").isNull() | (F.struct("cost", "hops") < F.struct("known_cost", "known_hops"))
        new = best.join(known, [*key, "node"], "left").where(less)
        if endless is not None:
            new = new.join(endless, key, "left_anti")
        rounds += 1
        new.select(schema.names).write.parquet(f"{folder}/n={rounds}")
        front = spark.read.schema(schema).parquet(f"{folder}/n={rounds}")
        done = front.isEmpty()
        if negative and (done or (rounds >= 8 and rounds & (rounds - 1) == 0)):
            found = _circles(_last(spark.read.schema(schema).parquet(folder), key), key)
            endless = found if endless is None else written(endless.union(found).distinct(), "ways-endless")
            front = front.join(endless, key, "left_anti")
            done = front.isEmpty()
        if done:
            break
    last = written(_last(spark.read.schema(schema).parquet(folder), key), "ways-last")
    ends = ways.select(*key, F.col("end").alias("node")).join(last.select(*key, "node", "cost"), [*key, "node"])
    if endless is not None:
        ends = ends.join(endless, key, "left_anti")
    traced = traces(last.where("up is not null").select(*key, "node", "up"), ends.select(*key, "node"), key)
    path = F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("back", "node"))), lambda x: x["node"]))
    return ends.select(*key, "cost").join(traced.groupBy(*key).agg(path.alias("path")), key)


def _last(rounds: DataFrame, key: list[str]) -> DataFrame:
    """What holds of each node after all rounds: key, node, cost, up (the node before; null at the start)."""
    best = rounds.groupBy(*key, "node").agg(F.min(F.struct("cost", "hops", F.coalesce("up", F.lit(-1)).alias("up"))).alias("b"))
    return best.select(*key, "node", "b.cost", F.nullif("b.up", F.lit(-1)).alias("up"))


def _circles(last: DataFrame, key: list[str]) -> DataFrame:
    """Keys some of whose pointers run in a circle: pointers are followed to pointers, so many times over that any line has ended."""
    jump = written(last.where("up is not null").select(*key, "node", "up"), "ways-jumps")
    for _ in range(max(1, jump.count()).bit_length() + 1):
        if jump.isEmpty():
            break
        after = jump.select(*key, F.col("node").alias("up"), F.col("up").alias("next"))
        before, jump = jump, written(jump.join(after, [*key, "up"]).select(*key, "node", F.col("next").alias("up")), "ways-jumps")
        forget(before)
    return written(jump.select(*key).distinct(), "ways-endless")


def traces(pointers: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """The nodes that pointers (key, node, up) lead back to from each end: key, node, back (steps from the end).

    Rounds follow the logarithm of the longest trace: what is known of its first nodes is repeated from where these end.
    """
    found = written(ends.select(*key, "node", F.lit(0).cast("long").alias("back")), "trace")
    jump, steps = written(pointers, "trace-jumps"), 1
    while True:
        more = found.join(jump, [*key, "node"]).select(*key, F.col("up").alias("node"), (F.col("back") + steps).alias("back"))
        more = written(more, "trace")
        if more.isEmpty():
            return found
        before, found = found, written(found.union(more), "trace")
        after = jump.select(*key, F.col("node").alias("up"), F.col("up").alias("next"))
        jump, steps = written(jump.join(after, [*key, "up"]).select(*key, "node", F.col("next").alias("up")), "trace-jumps"), 2 * steps
        forget(before, more)


def wrong_weights(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """src, dst, weight: the length of the node that an edge leads to if that is labelled -1, else 0."""
    weight = F.when(F.col(column) == -1, F.col("read_length")).otherwise(F.lit(0))
    return edges.select("src", "dst").join(nodes.select(F.col("node").alias("dst"), weight.cast("long").alias("weight")), "dst")


def near_best(edges: DataFrame, column: str, margin: float = 0.1) -> DataFrame:
    """Edges whose badness is at most ``margin`` above the least of their source's."""
    best = edges.groupBy("src").agg(F.min(column).alias("best"))
    return edges.join(best, "src").where(F.col(column) <= F.col("best") + margin).drop("best")


def reroute(walks: DataFrame, edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Each walk's lightest way from its first to its last node: hap, walk_id, cost (bases of the wrong haplotype), path."""
    ends = walks.groupBy(*WALK).agg(F.min_by("node", "pos").alias("start"), F.max_by("node", "pos").alias("end"))
    return lightest_ways(wrong_weights(edges, nodes, column), ends, WALK)


def fix_bubbles(walks: DataFrame, edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Walks whose runs of nodes labelled -1 are replaced by the lightest way between the nodes beside the run: hap, walk_id, pos,
    node. Runs at an end of a walk, and runs that no lighter way goes round, stay."""
    runs = wrong_runs(walks, nodes, column)
    at = lambda pos, name: walks.select(*WALK, F.col("pos").alias(pos), F.col("node").alias(name))
    beside = runs.withColumns({"before": F.col("first") - 1, "after": F.col("first") + F.col("n")}).join(at("before", "start"), [*WALK, "before"]).join(at("after", "end"), [*WALK, "after"])
    key = [*WALK, "first"]
    found = lightest_ways(wrong_weights(edges, nodes, column), beside.select(*key, "start", "end"), key)
    own = walks.join(nodes.select("node", "read_length"), "node").join(beside.select(*key, "before", "after"), WALK).where("pos > before and pos < after")
    now = own.groupBy(*key).agg(F.sum("read_length").alias("now"))
    lighter = written(found.join(now, key).where("cost < now").join(beside.select(*key, "before", "after"), key), "bubbles")
    rounds = lighter.select(*WALK, "before", "after", F.expr("slice(path, 2, size(path) - 2)").alias("inner"))
    gone = walks.join(rounds.select(*WALK, "before", "after"), WALK).where("pos > before and pos < after").select(*WALK, "pos")
    kept = walks.join(gone, [*WALK, "pos"], "left_anti").select(*WALK, F.col("pos").cast("long").alias("pos"), F.lit(0).alias("k"), "node")
    new = rounds.select(*WALK, F.col("before").cast("long").alias("pos"), F.posexplode("inner").alias("k", "node")).withColumn("k", F.col("k") + 1)
    place = F.row_number().over(Window.partitionBy(*WALK).orderBy("pos", "k")) - 1
    return kept.unionByName(new).select(*WALK, place.alias("pos"), "node")


def bellman_walks(walks: DataFrame, edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Walks replaced by the way between their ends that is lightest when a node labelled -1 weighs 10 and any other -1: hap,
    walk_id, pos, node.

    Right nodes draw a way on, so it may become longer. A walk from whose start a cycle of negative weight is reached has no
    lightest way and stays as it is, as does one of under three nodes.
    """
    weight = F.when(F.col(column) == -1, F.lit(10)).otherwise(F.lit(-1))
    weighted = edges.select("src", "dst").join(nodes.select(F.col("node").alias("dst"), weight.alias("weight")), "dst")
    ends = walks.groupBy(*WALK).agg(F.min_by("node", "pos").alias("start"), F.max_by("node", "pos").alias("end"), F.count(F.lit(1)).alias("n")).where("n > 2")
    ways = written(lightest_ways(weighted, ends.drop("n"), WALK), "bellman")
    new = ways.select(*WALK, F.posexplode("path").alias("pos", "node"))
    return walks.join(ways.select(*WALK), WALK, "left_anti").select(*WALK, F.col("pos").cast("int").alias("pos"), "node").union(new)


def extend_ends(walks: DataFrame, edges: DataFrame, nodes: DataFrame, columns: dict[str, str], score: str = "score") -> DataFrame:
    """Walks whose ends of nodes labelled -1 are taken off and grown anew along the best edges: hap, walk_id, pos, node.

    columns: the label's column of each haplotype. All ends of all walks grow at once, each by the edges of least badness to nodes
    that aren't labelled -1 and that its walk hasn't visited, complements and the nodes between an edge's ends included: first at
    the end, then at the beginning. An end that nothing goes on from stays as it is.
    """
    group = [F.lit(0).alias("component"), "hap"]
    kept = written(_by_hap(lambda w, c: trim_ends(w, nodes, c), walks, columns), "ends-kept")
    length = F.lit(0).cast("long").alias("prefix_length")
    graph = search_graph(edges.select("src", "dst", (-F.rint(F.col(score) * (1 << 20)) / (1 << 20)).alias("gain"), length).crossJoin(F.broadcast(kept.select("hap").distinct())).select(*group, "src", "dst", "gain", "prefix_length"))
    wrong = [nodes.where(F.col(c) == -1).select(F.lit(0).alias("component"), F.lit(h).alias("hap"), "node") for h, c in columns.items()]
    gone = wrong[0]
    for w in wrong[1:]:
        gone = gone.union(w)
    own = kept.select(*group, F.col("walk_id").alias("search"), F.explode(F.array("node", complement(F.col("node")))).alias("node"))
    ends = kept.groupBy(*WALK).agg(F.min_by("node", "pos").alias("first"), F.max_by("node", "pos").alias("last"), F.max("pos").alias("top"), F.min("pos").alias("low"))
    start = lambda node, backward: ends.select(*group, F.col("walk_id").alias("search"), F.lit(backward).alias("backward"), F.col(node).alias("node"))
    ahead, seen = beam_search(start("last", False), graph, 1, own, False, gone)
    behind, _ = beam_search(start("first", True), graph, 1, seen, False, gone)
    grown = lambda df, sign, end: df.select("hap", F.col("search").alias("walk_id"), F.posexplode("path").alias("k", "node")).where("k > 0").join(ends, WALK).select(*WALK, (F.col(end) + sign * F.col("k")).alias("place"), "node")
    rows = kept.select(*WALK, F.col("pos").alias("place"), "node").union(grown(ahead, 1, "top")).union(grown(behind, -1, "low"))
    low = rows.groupBy(*WALK).agg(F.min("place").alias("least"))
    return rows.join(low, WALK).select(*WALK, (F.col("place") - F.col("least")).cast("int").alias("pos"), "node")


def _by_hap(f, walks: DataFrame, columns: dict[str, str]) -> DataFrame:
    parts = [f(walks.where(F.col("hap") == h), c) for h, c in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def between(edges: DataFrame, ways: DataFrame, key: list[str]) -> DataFrame:
    """The edges on any way from each start to its end: key, src, dst. ways: key, start, end; edges: src, dst.

    These are the edges between nodes that the start reaches along the edges and the end against them.
    """
    step = written(edges.select("src", "dst").distinct(), "between-edges")
    ahead = reached(ways.select(*key, F.col("start").alias("node")), step, key)
    back = reached(ways.select(*key, F.col("end").alias("node")), step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), key)
    both = written(ahead.join(back, [*key, "node"]), "between")
    return both.withColumnRenamed("node", "src").join(step, "src").join(both.withColumnRenamed("node", "dst"), [*key, "dst"]).select(*key, "src", "dst")


def choke_points(edges: DataFrame, ways: DataFrame, key: list[str]) -> DataFrame:
    """Nodes that every way from a start to its end passes, both ends included: key, node, place (in order, from 0).

    Of the edges on any such way, nodes are put in layers by the longest way from the start; in the order of layers a node is passed by
    all ways if no edge leads from before it to behind it, and how many do is a running sum of edges that have begun less those
    that have ended. Searches whose edges hold a cycle, and pairs that nothing joins, give no row.
    """
    inner = written(between(edges, ways, key), "choke-edges")
    alone = ways.where(F.col("start") == F.col("end")).select(*key, F.col("start").alias("node"), F.lit(0).cast("long").alias("layer"))
    spark, folder, layer = edges.sparkSession, new_folder(edges.sparkSession, "layers"), 0
    rest = inner
    nodes = written(inner.select(*key, F.col("src").alias("node")).union(inner.select(*key, "dst")).distinct(), "choke-nodes")
    n_left = nodes
    while True:
        ready = n_left.join(rest.select(*key, F.col("dst").alias("node")).distinct(), [*key, "node"], "left_anti")
        ready.select(*key, "node", F.lit(layer).cast("long").alias("layer")).write.parquet(f"{folder}/n={layer}")
        ready = spark.read.parquet(f"{folder}/n={layer}").select(*key, "node")
        if ready.isEmpty():
            break
        n_left = written(n_left.join(ready, [*key, "node"], "left_anti"), "choke-left")
        rest = written(rest.join(ready.withColumnRenamed("node", "src"), [*key, "src"], "left_anti"), "choke-rest")
        layer += 1
    cyclic = n_left.select(*key).distinct()
    placed = spark.read.parquet(folder).select(*key, "node", "layer").unionByName(alone.join(nodes.select(*key).distinct(), key, "left_anti"))
    placed = written(placed.join(cyclic, key, "left_anti"), "choke-layers")
    begun = inner.groupBy(*key, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("begun"))
    ended = inner.groupBy(*key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ended"))
    rows = placed.join(begun, [*key, "node"], "left").join(ended, [*key, "node"], "left").fillna(0, ["begun", "ended"])
    # each search's edges all begin and end within it, so one running sum serves all searches
    rows = rows.select(*key, "node", "begun", "ended", F.struct(*key, "layer", "node").alias("order"), (F.col("begun") - F.col("ended")).alias("open"))
    over = running(rows, "order", ["open"]).where(F.col("open") == F.col("begun"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("order")) - 1
    return over.select(*key, "node", place.alias("place"))
