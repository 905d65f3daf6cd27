"""Walks improved by detours: off the walk at one node, greedily on, and back onto it at a later one.

Every edge beside a walk whose badness is near that of the walk's own edge begins a search. All searches of all walks go on together,
each to the best neighbour that neither its walk, up to where it left, nor itself has visited, on either strand; nodes of the
other haplotype and ambiguous ones cost extra. A search ends where it meets its walk again, finds no way on, or has become
longer than the rest of the walk allows. A round writes one row a search.

A detour replaces its stretch if it is about as long and holds fewer bases of the other haplotype. Of detours that overlap, on the
walk or in the nodes they take, the one that saves most goes first; others wait for the next turn. Each turn lowers a walk's wrong
bases, so turns end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.operators.metrics import WALK
from pairstrand.sources.shared import forget, new_folder, written

SEARCH = [*WALK, "i", "first"]


def _pair(c: str | Column) -> Column:
    return F.shiftright(c, 1)


def detours(walks: DataFrame, edges: DataFrame, labels: DataFrame, margin: float = 0.6, wrong: float = 0.6, ambiguous: float = 0.05, tolerance: float = 0.05) -> DataFrame:
    """Detours that replace stretches of walks for the better: hap, walk_id, i, first, j, saved, path (array of the nodes between).

    A detour leaves at place i by the edge to ``first`` and is back at place j (where ``first`` may lie itself). walks: hap, walk_id,
    pos, node; edges: src, dst, score, prefix_length; labels: hap, node, y.
    """
    spark, c = walks.sparkSession, F.col
    along = Window.partitionBy(*WALK).orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    of_dst = labels.select("hap", c("node").alias("dst"), "y")
    ways = edges.select("src", "dst", "score", "prefix_length")
    steps = walks.withColumn("dst", F.lead("node").over(along)).join(ways.withColumnRenamed("src", "node"), ["node", "dst"], "left").join(of_dst, ["hap", "dst"], "left")
    own = F.coalesce("prefix_length", F.lit(0))
    steps = steps.withColumns({"length": own, "bad": F.when(c("y") == -1, own).otherwise(0)})
    steps = steps.withColumns({"cum": F.coalesce(F.sum("length").over(before), F.lit(0)), "cum_bad": F.coalesce(F.sum("bad").over(before), F.lit(0)), "whole": F.sum("length").over(Window.partitionBy(*WALK))})
    on = written(steps.select(*WALK, "pos", "node", c("dst").alias("follows"), c("score").alias("own_score"), "cum", "cum_bad", "whole"), "detour-walks")
    index = on.select(*WALK, _pair("node").alias("pair"), c("node").alias("on_walk"), c("pos").alias("j"))

    def options(front: DataFrame) -> DataFrame:
        """Each search's ways on that its walk doesn't forbid: those to nodes off the walk, and those back to it."""
        go = front.join(ways.withColumnRenamed("src", "node"), "node").withColumn("pair", _pair("dst")).join(index, [*WALK, "pair"], "left")
        allowed = c("on_walk").isNull() | ((c("on_walk") == c("dst")) & (c("j") > c("i")))
        go = go.where(allowed).join(of_dst, ["hap", "dst"], "left")
        cost = c("score") + F.when(c("y") == -1, wrong).when(c("y") == 0, ambiguous).otherwise(0.0)
        return go.withColumns({"cost": cost, "bad": F.when(c("y") == -1, c("prefix_length")).otherwise(0)})

    left = on.where("follows is not null").select(*WALK, c("pos").alias("i"), "node", "follows", "own_score", ((c("whole") - c("cum")) * (1 + tolerance)).alias("room"))
    first = options(left).where((c("dst") != c("follows")) & (F.abs(c("score") - c("own_score")) <= margin) & (c("prefix_length") <= c("room")))
    first = first.select(*WALK, "i", c("dst").alias("first"), F.lit(0).alias("step"), c("dst").alias("node"), c("prefix_length").cast("long").alias("length"), c("bad").cast("long").alias("bad"), "j", "room")
    folder, rounds = new_folder(spark, "detours"), 0
    first.write.parquet(f"{folder}/n=0")
    schema = first.schema
    front = spark.read.schema(schema).parquet(f"{folder}/n=0").where("j is null")
    while not front.isEmpty():
        rounds += 1
        seen = spark.read.schema(schema).parquet(folder).select(*SEARCH, _pair("node").alias("pair"))
        go = options(front.drop("j").withColumnRenamed("bad", "so_far")).join(seen, [*SEARCH, "pair"], "left_anti").where(c("length") + c("prefix_length") <= c("room"))
        best = go.groupBy(*SEARCH).agg(F.min(F.struct("cost", "dst", "prefix_length", c("bad").alias("worse"), "j", "length", "room", "so_far")).alias("b"))
        new = best.select(*SEARCH, F.lit(rounds).alias("step"), c("b.dst").alias("node"), (c("b.length") + c("b.prefix_length")).alias("length"), (c("b.so_far") + c("b.worse")).alias("bad"), "b.j", "b.room")
        new.write.parquet(f"{folder}/n={rounds}")
        front = spark.read.schema(schema).parquet(f"{folder}/n={rounds}").where("j is null")
    rows = spark.read.schema(schema).parquet(folder)
    place = lambda name: on.select(*WALK, c("pos").alias(name), c("cum").alias(f"cum_{name}"), c("cum_bad").alias(f"bad_{name}"))
    back = rows.where("j is not null").join(place("i"), [*WALK, "i"]).join(place("j"), [*WALK, "j"])
    stretch = c("cum_j") - c("cum_i")
    good = back.where((F.abs(c("length") - stretch) <= tolerance * stretch) & (c("bad") < c("bad_j") - c("bad_i")))
    good = good.select(*SEARCH, "j", (c("bad_j") - c("bad_i") - c("bad")).alias("saved"))
    inner = F.transform(F.sort_array(F.collect_list(F.when(c("at_j").isNull(), F.struct("step", "node")))), lambda x: x["node"])
    paths = rows.withColumnRenamed("j", "at_j").join(good.select(*SEARCH), SEARCH, "left_semi").groupBy(*SEARCH).agg(inner.alias("path"))
    return good.join(paths, SEARCH)


def compatible(found: DataFrame) -> DataFrame:
    """Of detours those that none which saves more (of equals, that leaves earlier, then to a smaller node) overlaps."""
    found = written(found, "detours-found")
    rank = F.struct("saved", (-F.col("i")).alias("i"), (-F.col("first")).alias("first"))
    places = F.transform(F.sequence("i", F.col("j") - 1), lambda x: F.struct(F.lit(True).alias("place"), x.cast("long").alias("k")))
    nodes = F.transform("path", lambda x: F.struct(F.lit(False).alias("place"), _pair(x).alias("k")))
    taken = found.select(*SEARCH, rank.alias("rank"), F.explode(F.concat(places, nodes)).alias("t")).select(*SEARCH, "rank", "t.place", "t.k")
    top = taken.groupBy(*WALK, "place", "k").agg(F.max("rank").alias("top"))
    second = taken.join(top, [*WALK, "place", "k"]).where("rank <> top").select(*SEARCH).distinct()
    return found.join(second, SEARCH, "left_anti")


def explored(walks: DataFrame, edges: DataFrame, nodes: DataFrame, columns: dict[str, str], **limits: float) -> DataFrame:
    """Walks with all the detours that make them better: hap, walk_id, pos, node. columns: the label's column of each haplotype."""
    hap_labels = [nodes.select(F.lit(h).alias("hap"), "node", F.col(col).alias("y")) for h, col in columns.items()]
    labels = hap_labels[0]
    for x in hap_labels[1:]:
        labels = labels.union(x)
    labels = written(labels, "detour-labels")
    place = (F.row_number().over(Window.partitionBy(*WALK).orderBy("pos")) - 1).cast("int")
    now = written(walks.select(*WALK, place.alias("pos"), "node"), "detour-now")
    done = None
    while True:
        chosen = written(compatible(detours(now, edges, labels, **limits)), "detours-chosen")
        changed = chosen.select(*WALK).distinct()
        # walks without a detour are finished
        rest = written(now.join(changed, WALK, "left_anti"), "detour-done")
        done = rest if done is None else done.union(rest)
        if chosen.isEmpty():
            return done
        gone = chosen.select(*WALK, F.explode(F.sequence("i", F.col("j") - 1)).alias("pos"), "i").where("pos > i").select(*WALK, "pos")
        kept = now.join(changed, WALK, "left_semi").join(gone, [*WALK, "pos"], "left_anti").select(*WALK, "pos", F.lit(-1).alias("k"), "node")
        new = chosen.select(*WALK, F.col("i").alias("pos"), F.posexplode("path").alias("k", "node"))
        order = (F.row_number().over(Window.partitionBy(*WALK).orderBy("pos", "k")) - 1).cast("int")
        before, now = now, written(kept.unionByName(new).select(*WALK, order.alias("pos"), "node"), "detour-now")
        forget(before)
