"""Extraction of walks: beam search from sampled edges, peeled off component by component.

Cuts, components, haplotypes and edge scores are DataFrame plans, and so is the search. A state of a search is a narrow row: where
it stands, its gain, and its line of descent. A round joins all states of all searches, from all starts in all components, to
the edges out of their nodes, drops what they have visited, and keeps the best by windows over a search's few rows. So a
component lies in no one task.

Searches run on chains. Unbranching chains of a group's graph are found once, by pointer doubling, with running sums of gains and
lengths; edges are only kept where chains end. While all states of a search stand inside chains nothing can be decided, so they leap
at once, as far as the first of them comes to its chain's end, to something visited or to a state that has stopped. Rounds
follow the branches on a walk, not its length.

What a round adds is all it writes: the stretches of chains that its states have walked or marked as visited. Each belongs to a line, a
number that a state hands on to its first child; other children open lines of their own. A state names the lines it descends
from, each up to a round, and sees only their stretches. What all moving states of a search have in common is the search's
trunk, and leaves their lists. Paths are put together once, at the end. Gains are multiples of 2^-20, so that sums are the
same in any order. Ties go to the smaller node; starts are chosen by a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairstrand.functions.strings import complement
from pairstrand.operators.components import find_components
from pairstrand.operators.cuts import double_cut
from pairstrand.operators.graph import common_neighbours
from pairstrand.operators.score import beam_edge_score, graphic_edge_score
from pairstrand.operators.simplify import chains_of
from pairstrand.sources.shared import bucketed, new_folder, written

#: What a search belongs to, and what names it.
GROUP = ["component", "hap"]
SEARCH = [*GROUP, "search"]


@dataclass(frozen=True)
class Strategy:
    """Parameters of a decoding. ``visited``: shared_neighbors, 1-hop, 2-hop or full_component."""

    c_t: float = 0.5
    c_b: float = 0.9
    min_component_size: int = 25
    min_walk_length: int = 100_000
    min_path_length: int = 25
    beam_width: int = 5
    beam_intermediate: bool = True
    sample_size: int = 100
    sample_by_score: bool = False
    visited: str = "2-hop"
    alpha: float = 1e-5
    beta: float = 3.0
    gamma: float = 25.0
    graphic_threshold: float = 0.0
    graphic: bool = False


#: The named decoding strategies.
STRATEGIES = {
    "beam": Strategy(),
    "greedy": Strategy(beam_width=1),
    "graphic": Strategy(beam_width=10, beta=10.0, gamma=20.0, graphic=True),
}


#: Keys of strategies in a YAML file, and what they are called here.
KEYS = {"mark_as_visited": "visited", "thr_graphic": "graphic_threshold"}


def read_strategies(path: str) -> dict[str, Strategy]:
    """The strategies of a YAML file: a mapping of names to parameters, of which the known ones are taken."""
    import yaml

    with open(path, encoding="utf-8") as f:
        named = yaml.safe_load(f)
    known = Strategy.__dataclass_fields__
    return {name: Strategy(**{KEYS.get(k, k): v for k, v in given.items() if KEYS.get(k, k) in known}, graphic=name == "graphic") for name, given in named.items()}


@dataclass
class SearchGraph:
    """What searches see. places: group, node, head (the chain's name), pos, last (of the chain), hairpin (whether the chain holds a
    node and its complement), gain and length (sums from the head to the node), other_head and other_pos (of the
    complement). exits: group, backward, node, and per edge out of a chain: next, its place, gain, prefix_length, around (places of the
    nodes between the edge's ends and of their complements). Each round looks at a few rows of these: exits are dealt by where
    they begin, places by their chain (chains) and by where they are in it (stops), so none of them is shuffled again."""

    places: DataFrame
    exits: DataFrame
    chains: DataFrame
    stops: DataFrame


def search_graph(edges: DataFrame) -> SearchGraph:
    """The graph of edges (component, hap, src, dst, gain, prefix_length)."""
    plain = written(edges.select(*GROUP, "src", "dst", "gain", "prefix_length"), "search-edges")
    haps = sorted((r["hap"] for r in plain.select("hap").distinct().collect()), key=repr)  # as many as there are haplotypes
    number = F.coalesce(F.array_position(F.array(*(F.lit(h) for h in haps)), F.col("hap")) - 1, F.lit(0)) if haps else F.lit(0)
    inside = lambda node: F.col(node) * max(1, len(haps)) + number
    alone = lambda end: plain.groupBy(*GROUP, end).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*GROUP, end)
    linear = plain.join(alone("src"), [*GROUP, "src"], "left_semi").join(alone("dst"), [*GROUP, "dst"], "left_semi").where(F.col("dst") != complement(F.col("src")))
    linear = linear.select(inside("src").alias("src"), inside("dst").alias("dst"), F.col("gain").alias("gain"), F.col("prefix_length").cast("long").alias("length"))
    chain = written(chains_of(linear, ("gain", "length")).withColumnRenamed("node", "id"), "search-chains")
    chain = chain.join(chain.groupBy("head").agg(F.max("pos").alias("last")), "head")
    nodes = plain.select(*GROUP, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", inside("node"))
    place = nodes.join(chain, "id", "left").select(
        *GROUP, "node", F.coalesce("head", "id").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("length", F.lit(0)).alias("length")
    )
    place = written(place, "search-nodes")
    other = place.select(*GROUP, complement(F.col("node")).alias("node"), F.col("head").alias("other_head"), F.col("pos").alias("other_pos"))
    with_other = place.join(other, [*GROUP, "node"], "left")
    hairpins = with_other.where("head = other_head").select(*GROUP, "head").distinct().withColumn("hairpin", F.lit(True))
    places = written(with_other.join(hairpins, [*GROUP, "head"], "left").withColumn("hairpin", F.coalesce("hairpin", F.lit(False))), "search-places")
    via = common_neighbours(plain.select("src", "dst").distinct())
    at = places.select(*GROUP, F.col("node").alias("via"), F.struct("head", "pos").alias("own"), F.struct(F.col("other_head").alias("head"), F.col("other_pos").alias("pos")).alias("twin"))
    between = plain.select(*GROUP, "src", "dst").join(via, ["src", "dst"]).join(at, [*GROUP, "via"])
    around = between.groupBy(*GROUP, "src", "dst").agg(F.flatten(F.collect_list(F.filter(F.array("own", "twin"), lambda x: x["head"].isNotNull()))).alias("around"))
    # edges along a chain aren't exits; the others leave from its end forward, and from its head backward
    spot = {"head": "head", "pos": "pos", "last": "last", "hairpin": "hairpin", "gain": "cum_gain", "length": "cum_length"}
    of = lambda end: places.select(*GROUP, F.col("node").alias(end), *(F.col(c).alias(f"{end}_{to}") for c, to in spot.items()))
    both = plain.join(of("src"), [*GROUP, "src"]).join(of("dst"), [*GROUP, "dst"]).where("src_head <> dst_head or dst_pos <> src_pos + 1").join(around, [*GROUP, "src", "dst"], "left")

    def one(backward: bool, node: str, nxt: str) -> DataFrame:
        return both.select(*GROUP, F.lit(backward).alias("backward"), F.col(node).alias("node"), F.col(nxt).alias("next"), *(F.col(f"{nxt}_{to}").alias(f"to_{to}") for to in spot.values()), F.col("gain").alias("edge_gain"), "prefix_length", "around")

    exits = bucketed(one(False, "src", "dst").union(one(True, "dst", "src")), "search-exits", [*GROUP, "backward", "node"])
    stops = places.select(*GROUP, "head", F.col("pos").alias("goal"), F.col("node").alias("goal_node"), F.col("gain").alias("goal_gain"), F.col("length").alias("goal_length"))
    return SearchGraph(places, exits, bucketed(places, "search-chains-dealt", [*GROUP, "head"]), bucketed(stops, "search-stops", [*GROUP, "head", "goal"]))


#: Line of what all states of a search see from its start.
BASE = -1
#: Kinds of stretches: walked, their complements, nodes between an edge's ends and what may not be visited from the beginning.
WALKED, OTHER, BESIDE = 0, 1, 2
_TOP = "struct<total:double,back:bigint,node:bigint,length:bigint>"
_LINES = "array<struct<id:bigint,until:int>>"
_OPEN = 2**31 - 1


def _sees(lines: Column, line: Column, at: Column) -> Column:
    """Whether a state of these lines descends from what a line has walked in round ``at``."""
    return F.exists(lines, lambda x: (x["id"] == line) & (at <= x["until"]))


def _of_state(states: DataFrame, more: DataFrame) -> DataFrame:
    """States with what is known of them by search and slot, met by search alone."""
    other = more.select(*(F.col(k).alias(f"{k}_") for k in [*SEARCH, "slot"]), *(k for k in more.columns if k not in [*SEARCH, "slot"]))
    meant = F.col("slot") - F.col("slot_") == 0  # not a key, or rows would be dealt anew by it
    for k in SEARCH:
        meant &= F.col(k) == F.col(f"{k}_")
    return states.join(other, meant, "left").drop(*(f"{k}_" for k in [*SEARCH, "slot"]))


def beam_search(starts: DataFrame, graph: SearchGraph, width: int, seen: DataFrame, intermediate: bool = True, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best walk of each search: component, hap, search, path, total, length (sum of prefix lengths); and what it has
    visited: component, hap, search, node.

    starts: component, hap, search, backward, node. seen: what a search may not visit from the beginning (component, hap,
    search, node); gone: what none in a group may (component, hap, node). Each state goes on to its best unvisited neighbours,
    at most ``width``; a state without any stays. Of states that end in one node the best is kept, and of all the ``width``
    best; a search ends when none of its states goes on. With ``intermediate`` a better state of an earlier step wins.
    """
    spark, folder = starts.sparkSession, new_folder(starts.sparkSession, "beam")
    places, exits = graph.places, graph.exits
    where = places.select(*GROUP, "node", "head", "pos", "last", "hairpin", F.col("gain").alias("cum_gain"), F.col("length").alias("cum_length"))
    own = starts.select(*SEARCH, F.explode(F.array("node", complement(F.col("node")))).alias("node"))
    base = seen.select(*SEARCH, "node").union(own).distinct().join(where.select(*GROUP, "node", "head", "pos"), [*GROUP, "node"])
    stretches = base.select(*SEARCH, F.lit(BASE).cast("long").alias("line"), F.lit(-1).alias("round"), F.lit(BESIDE).alias("kind"), "head", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.lit(None).cast(_TOP).alias("top"))
    stretches.write.parquet(f"{folder}/stretches/n=-1")
    stretch_schema = stretches.schema
    blocked = written((gone if gone is not None else starts.select(*GROUP, "node").limit(0)).join(where.select(*GROUP, "node", "head", "pos"), [*GROUP, "node"]).select(*GROUP, "head", F.col("pos").alias("lo"), F.col("pos").alias("hi")), "beam-gone")
    lines = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(_OPEN).alias("until")))
    first = starts.join(where, [*GROUP, "node"], "left").select(
        *SEARCH, "backward", F.lit(0).alias("slot"), "node", F.coalesce("head", F.lit(-1)).alias("head"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("hairpin", F.lit(False)).alias("hairpin"),
        F.coalesce("cum_gain", F.lit(0.0)).alias("cum_gain"), F.coalesce("cum_length", F.lit(0)).alias("cum_length"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("length"),
        lines.alias("lines"), F.lit(-1).alias("since"), F.lit(-1).alias("round"), F.lit(True).alias("moving"), F.lit(True).alias("alive"), F.array().cast(_LINES).alias("shared"),
    )
    first.write.parquet(f"{folder}/states/n=-1")
    schema, states, rounds = first.schema, spark.read.schema(first.schema).parquet(f"{folder}/states/n=-1"), 0
    # the number of a round comes from the rows, not from here, so that each round's plan compiles to the same code
    this = F.col("round") + 1
    of_search, of_state = Window.partitionBy(*SEARCH), Window.partitionBy(*SEARCH, "slot")
    while True:
        moving = states.where("moving")
        room = F.when(F.col("backward"), F.col("pos")).otherwise(F.col("last") - F.col("pos"))
        along = F.when(F.col("backward"), F.lit(-1)).otherwise(F.lit(1))
        # what states look at: the rest of their chain, or the places behind the exits at its end
        ends = moving.where(room == 0).join(exits, [*GROUP, "backward", "node"])
        look = moving.where(room > 0).select(*SEARCH, "slot", "lines", F.lit(-1).cast("long").alias("next"), along.alias("along"), "head", (F.col("pos") + along).alias("from"))
        look = look.union(ends.select(*SEARCH, "slot", "lines", "next", F.lit(0), "to_head", "to_pos"))
        marks = spark.read.schema(stretch_schema).parquet(f"{folder}/stretches").select(*SEARCH, "line", "round", "head", "lo", "hi")
        trunk = spark.read.schema(schema).parquet(f"{folder}/states").select(*SEARCH, F.explode("shared").alias("x")).select(*SEARCH, F.col("x.id").alias("line"), F.col("x.until").alias("until"))
        ahead = ((F.col("along") == 1) & (F.col("hi") >= F.col("from"))) | ((F.col("along") == -1) & (F.col("lo") <= F.col("from"))) | ((F.col("along") == 0) & F.col("from").between(F.col("lo"), F.col("hi")))
        visible = (F.col("line") == BASE) | (F.col("round") <= F.col("until")) | _sees(F.col("lines"), F.col("line"), F.col("round"))
        met = look.join(marks, [*SEARCH, "head"]).where(ahead).join(trunk, [*SEARCH, "line"], "left").where(F.coalesce(visible, F.lit(False))).select(*SEARCH, "slot", "next", "along", "from", "lo", "hi")
        met = met.union(look.join(blocked, [*GROUP, "head"]).where(ahead).select(*SEARCH, "slot", "next", "along", "from", "lo", "hi"))
        # free steps from the place looked at; of one behind an exit only whether it is free
        steps = F.when(F.col("along") == 1, F.greatest("lo", "from") - F.col("from")).when(F.col("along") == -1, F.col("from") - F.least("hi", "from")).otherwise(0)
        free = met.groupBy(*SEARCH, "slot", "next").agg(F.min(steps).alias("free"))
        free_exits = ends.join(free, [*SEARCH, "slot", "next"], "left_anti").select(*SEARCH, "slot", "next", "to_head", "to_pos", "to_last", "to_hairpin", "to_cum_gain", "to_cum_length", "edge_gain", "prefix_length", "around")
        # a search has few states: all that they choose by is dealt by search, and which state is meant is looked at there
        rows = _of_state(_of_state(states, free.where("next = -1").select(*SEARCH, "slot", "free")), free_exits)
        rows = rows.withColumn("room", F.least(room, F.coalesce("free", room))).withColumn("stops", ~F.col("moving") | ((room > 0) & (F.col("room") == 0)))
        stopped = F.collect_set(F.when(F.col("stops"), F.struct("head", "pos"))).over(of_search)
        rows = rows.withColumn("stopped", stopped)
        meets = F.array_min(F.transform(F.filter("stopped", lambda x: (x["head"] == F.col("head")) & ((x["pos"] - F.col("pos")) * along > 0)), lambda x: (x["pos"] - F.col("pos")) * along))
        inside = ~F.col("stops") & (F.col("room") > 0)
        most = F.when(inside, F.least("room", F.coalesce(meets, "room"), F.when(F.col("hairpin"), F.lit(1)))).when(~F.col("stops") & F.col("next").isNotNull(), F.lit(1))
        rows = rows.withColumn("leap", F.min(most).over(of_search))
        # one row an option: a leap, an exit, or staying
        leaps = F.col("leap") * along
        rows = rows.withColumns({"open": inside | F.col("next").isNotNull(), "goal": F.when(inside, F.col("pos") + leaps)})
        rows = rows.drop("stopped", "free").join(graph.stops, [*GROUP, "head", "goal"], "left").repartition(*SEARCH)
        pick = lambda leap, way, stay: F.when(inside, leap).when(F.col("next").isNotNull(), way).otherwise(stay)
        c = F.col
        rows = rows.withColumns(
            {
                "end": pick(c("goal_node"), c("next"), c("node")),
                "gained": pick((c("goal_gain") - c("cum_gain")) * along, c("edge_gain"), F.lit(0.0)),
                "grown": pick((c("goal_length") - c("cum_length")) * along, c("prefix_length"), F.lit(0)),
            }
        )
        rows = rows.withColumns({"k": F.row_number().over(of_state.orderBy(F.desc("gained"), "end")), "now": c("total") + c("gained")}).where((c("k") <= width))
        rows = rows.withColumn("at_end", F.row_number().over(Window.partitionBy(*SEARCH, "end").orderBy(F.desc("now"), "slot", "k"))).where("at_end = 1")
        rows = rows.withColumn("new_slot", (F.row_number().over(of_search.orderBy(F.desc("now"), "end")) - 1).cast("int")).where(c("new_slot") < width)
        # the first kept child takes its parent's line, others open their own
        rows = rows.withColumn("child", F.row_number().over(of_state.orderBy("new_slot")))
        closed = F.transform("lines", lambda x: F.struct(x["id"].alias("id"), F.least(x["until"], F.col("round")).alias("until")))
        opened = F.concat(closed, F.array(F.struct((this * width + 1 + c("new_slot")).cast("long").alias("id"), F.lit(_OPEN).alias("until"))))
        rows = rows.withColumn("lines", F.when(~c("open") | (c("child") == 1), c("lines")).otherwise(opened))
        rows = rows.withColumn("all", F.collect_list(F.when(c("open"), c("lines"))).over(of_search)).withColumn("alive", F.max("open").over(of_search))
        shortest = F.array_min(F.transform("all", lambda x: F.size(x)))
        apart = F.array_min(F.filter(F.sequence(F.lit(0), shortest - 1), lambda i: (F.size(F.array_distinct(F.transform("all", lambda x: x[i]))) > 1) | (F.col("all")[0][i]["until"] == _OPEN)))
        same = F.when(F.size("all") > 0, F.coalesce(apart, F.lit(0)))
        rows = rows.withColumn("same", F.coalesce(same, F.lit(0)).cast("int"))
        one_of_all = F.row_number().over(of_search.orderBy(F.desc("open"), "new_slot")) == 1
        new = rows.withColumn("tells", one_of_all & c("open")).select(
            *SEARCH, "backward", c("new_slot").alias("slot"), c("end").alias("node"),
            pick(c("head"), c("to_head"), c("head")).alias("head"), pick(c("goal"), c("to_pos"), c("pos")).alias("pos"), pick(c("last"), c("to_last"), c("last")).alias("last"), pick(c("hairpin"), c("to_hairpin"), c("hairpin")).alias("hairpin"),
            pick(c("goal_gain"), c("to_cum_gain"), c("cum_gain")).alias("cum_gain"), pick(c("goal_length"), c("to_cum_length"), c("cum_length")).alias("cum_length"), c("now").alias("total"), (c("length") + c("grown")).alias("length"),
            F.when(c("open"), F.slice("lines", c("same") + 1, F.size("lines"))).otherwise(c("lines")).alias("lines"), F.when(c("open"), this).otherwise(c("since")).alias("since"), this.alias("round"), c("open").alias("moving"), "alive",
            F.when(c("tells"), F.slice("lines", F.lit(1), c("same"))).otherwise(F.array().cast(_LINES)).alias("shared"),
            c("pos").alias("was"), c("total").alias("before"), c("cum_gain").alias("was_gain"), c("length").alias("was_length"), c("cum_length").alias("was_cum"), inside.alias("leapt"), F.coalesce("around", F.array()).alias("around"),
        )
        at = f"{folder}/states/n={rounds}"
        new.write.parquet(at)
        moved = spark.read.schema(new.schema).parquet(at).where("moving")
        # stretches walked, those of the complements, and the nodes between an exit's ends
        low = F.when(~c("leapt"), c("pos")).when(c("backward"), c("pos")).otherwise(c("was") + 1)
        high = F.when(~c("leapt"), c("pos")).when(c("backward"), c("was") - 1).otherwise(c("pos"))
        line = F.element_at("lines", -1)["id"]
        parts = moved.select(*SEARCH, "round", "backward", line.alias("line"), "head", low.alias("lo"), high.alias("hi"), "leapt", "before", "total", "was", "was_gain", "was_length", "was_cum", "length")
        on = parts.join(graph.chains.select(*GROUP, "head", c("pos").alias("p"), c("node").alias("p_node"), c("gain").alias("p_gain"), c("length").alias("p_length"), "other_head", "other_pos"), [*GROUP, "head"]).where(c("p").between(c("lo"), c("hi")))
        sign = F.when(c("backward"), F.lit(-1)).otherwise(F.lit(1))
        total_at = F.when(c("leapt"), c("before") + (c("p_gain") - c("was_gain")) * sign).otherwise(c("total"))
        length_at = F.when(c("leapt"), c("was_length") + (c("p_length") - c("was_cum")) * sign).otherwise(c("length"))
        top = F.struct(total_at.alias("total"), (-F.when(c("leapt"), F.abs(c("p") - c("was"))).otherwise(1)).alias("back"), (-c("p_node")).alias("node"), length_at.alias("length"))
        each = on.select(*SEARCH, "round", "line", F.explode(F.array(F.struct(F.lit(WALKED).alias("kind"), c("head").alias("head"), c("p").alias("p"), F.lit(0).cast("long").alias("run"), top.alias("top")), F.struct(F.lit(OTHER).alias("kind"), c("other_head").alias("head"), c("other_pos").alias("p"), (c("p") + c("other_pos")).alias("run"), F.lit(None).cast(_TOP).alias("top")))).alias("x")).select(*SEARCH, "round", "line", "x.*").where("head is not null")
        beside = moved.select(*SEARCH, "round", line.alias("line"), F.explode("around").alias("x")).select(*SEARCH, "round", "line", F.lit(BESIDE).alias("kind"), c("x.head").alias("head"), c("x.pos").alias("p"), (-1 - c("x.pos")).alias("run"), F.lit(None).cast(_TOP).alias("top"))
        added = each.unionByName(beside).groupBy(*SEARCH, "round", "line", "kind", "head", "run").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("top").alias("top"))
        added.select(*SEARCH, "line", "round", "kind", "head", "lo", "hi", "top").write.parquet(f"{folder}/stretches/n={rounds}")
        states = spark.read.schema(schema).parquet(at).where("alive")
        rounds += 1
        if states.isEmpty():
            break
    return _paths(folder, schema, stretch_schema, places, starts, intermediate)


def _paths(folder: str, schema: StructType, stretch_schema: StructType, places: DataFrame, starts: DataFrame, intermediate: bool) -> tuple[DataFrame, DataFrame]:
    """What ``beam_search`` returns, from all that its rounds have written."""
    spark, c = starts.sparkSession, F.col
    states = spark.read.schema(schema).parquet(f"{folder}/states")
    stretches = spark.read.schema(stretch_schema).parquet(f"{folder}/stretches")
    final = states.where("not alive and slot = 0").select(*SEARCH, "total", "length", "lines", "since")
    top = F.max(F.struct(c("top.total").alias("total"), (-c("round")).alias("back"), c("top.back").alias("step"), c("top.node").alias("node"), c("line").alias("line"), c("top.length").alias("length")))
    best = stretches.where("top is not null").groupBy(*SEARCH).agg(top.alias("b")).select(*SEARCH, c("b.total").alias("best"), (-c("b.back")).alias("since"), (-c("b.step")).alias("cut"), c("b.line").alias("line"), c("b.length").alias("best_length"))
    lines = states.where("moving and since >= 0").select(*SEARCH, "since", F.element_at("lines", -1)["id"].alias("line"), c("lines").alias("best_lines"))
    best = best.join(lines, [*SEARCH, "since", "line"]).withColumnRenamed("since", "best_since")
    rows = final.join(best, SEARCH, "left")
    bare = F.lit(intermediate) & (F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)) > c("total")) & (F.coalesce("best", F.lit(0.0)) <= 0)
    better = F.lit(intermediate) & (c("best") > c("total")) & (c("best") > 0)
    pick = lambda start, one, last: F.when(bare, start).when(better, one).otherwise(last)
    rows = rows.select(
        *SEARCH, pick(F.lit(0.0), c("best"), c("total")).alias("total"), pick(F.lit(0), c("best_length"), c("length")).alias("length"), pick(F.array().cast(_LINES), c("best_lines"), c("lines")).alias("lines"),
        pick(F.lit(-1), c("best_since"), c("since")).alias("since"), F.when(better, c("cut")).alias("cut"),
    )
    rows = written(rows, "beam-chosen")
    trunk = states.select(*SEARCH, c("since").alias("told"), F.explode("shared").alias("x")).select(*SEARCH, c("x.id").alias("line"), c("x.until").alias("until"), "told")
    seen = stretches.drop("top").join(trunk, [*SEARCH, "line"], "left").join(rows.select(*SEARCH, "lines", "since", "cut"), SEARCH)
    on_trunk = F.coalesce((c("round") <= c("until")) & (c("told") <= c("since")), F.lit(False))
    seen = seen.where(((c("line") == BASE) | on_trunk | _sees(c("lines"), c("line"), c("round"))) & (c("round") <= c("since")) & (c("kind") != OTHER))
    backward = starts.select(*SEARCH, "backward", c("node").alias("start"))
    nodes = seen.join(places.select(*GROUP, "head", c("pos").alias("p"), "node"), [*GROUP, "head"]).where(c("p").between(c("lo"), c("hi"))).join(backward, SEARCH)
    nodes = nodes.withColumn("step", F.when(c("backward"), c("hi") - c("p")).otherwise(c("p") - c("lo")) + 1)
    nodes = nodes.where((c("kind") != WALKED) | c("cut").isNull() | (c("round") < c("since")) | (c("step") <= c("cut")))
    nodes = written(nodes.select(*SEARCH, "kind", "round", "step", "node"), "beam-nodes")
    steps = nodes.where(c("kind") == WALKED).groupBy(*SEARCH).agg(F.transform(F.sort_array(F.collect_list(F.struct("round", "step", "node"))), lambda x: x["node"]).alias("steps"))
    path = F.concat(F.array("start"), F.coalesce("steps", F.array().cast("array<bigint>")))
    walks = rows.join(backward, SEARCH).join(steps, SEARCH, "left").select(*SEARCH, path.alias("path"), "total", "length")
    on = backward.select(*SEARCH, c("start").alias("node")).union(nodes.where(c("kind") == WALKED).select(*SEARCH, "node"))
    visited = nodes.where(c("kind") != WALKED).select(*SEARCH, "node").union(on.select(*SEARCH, F.explode(F.array("node", complement(c("node")))).alias("node")))
    return walks, visited.distinct()


def walks_through(starts: DataFrame, edges: DataFrame, s: Strategy, graph: SearchGraph | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The walk through each start (component, hap, search, src, dst): forward from its end, backward from its beginning, on the
    other strand if that is in the component. Returns component, hap, search, path, length.

    edges: component, hap, src, dst, prefix_length, src_length, dst_length, gain. graph: ``search_graph`` of these or of more
    edges, of which all nodes that are not in these are in ``gone`` (component, hap, node).
    """
    graph = graph or search_graph(edges)
    mine = starts.select(*SEARCH, F.explode(F.array("src", complement(F.col("src")))).alias("node"))
    ahead, seen = beam_search(starts.select(*SEARCH, F.lit(False).alias("backward"), F.col("dst").alias("node")), graph, s.beam_width, mine, s.beam_intermediate, gone)
    sizes = edges.select(*GROUP, F.col("src").alias("node"), F.col("src_length").alias("size")).union(edges.select(*GROUP, "dst", "dst_length")).distinct()
    other = sizes.select(*GROUP, F.col("node").alias("twin"), F.lit(True).alias("has_twin"))
    turned = ahead.select(*SEARCH, F.col("path").alias("ahead")).join(starts, SEARCH).withColumn("twin", complement(F.col("src"))).join(other, [*GROUP, "twin"], "left")
    turned = written(turned.withColumn("backward", F.col("has_twin").isNull()), "walks-turned")
    back = turned.select(*SEARCH, "backward", F.when(F.col("backward"), F.col("src")).otherwise(F.col("twin")).alias("node"))
    behind, _ = beam_search(back, graph, s.beam_width, seen.join(mine, [*SEARCH, "node"], "left_anti"), s.beam_intermediate, gone)
    whole = turned.join(behind.select(*SEARCH, F.col("path").alias("behind")), SEARCH)
    path = F.concat(F.reverse(F.when(F.col("backward"), F.col("behind")).otherwise(F.transform("behind", complement))), "ahead")
    whole = written(whole.select(*SEARCH, path.alias("path")), "walks")
    steps = whole.select(*SEARCH, F.posexplode("path").alias("pos", "node"), F.col("path")).withColumn("dst", F.get("path", F.col("pos") + 1)).drop("path")
    sized = steps.join(sizes, [*GROUP, "node"], "left").join(edges.select(*GROUP, F.col("src").alias("node"), "dst", "prefix_length"), [*GROUP, "node", "dst"], "left")
    lengths = sized.groupBy(*SEARCH).agg(F.sum(F.coalesce("prefix_length", "size", F.lit(0))).alias("length"))
    return whole.join(lengths, SEARCH)


def sampled_starts(edges: DataFrame, s: Strategy, seed: int = 0) -> DataFrame:
    """Edges to start from, ``sample_size`` a group: the first by a hash, or those of the largest gains; search is their rank."""
    order = [F.desc("gain")] if s.sample_by_score else [F.md5(F.concat_ws("-", "src", "dst", F.lit(str(seed))))]
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order, "src", "dst"))
    return edges.select(*GROUP, rank.alias("search"), "src", "dst").where(F.col("search") <= s.sample_size)


def used_up(walks: DataFrame, edges: DataFrame, strategy: str) -> DataFrame:
    """Nodes that walks (component, hap, path) use up, with their complements: component, hap, node."""
    on = walks.select(*GROUP, F.explode("path").alias("node"))
    if strategy == "full_component":
        both = edges.join(walks.select(*GROUP).distinct(), GROUP, "left_semi")
        out = both.select(*GROUP, F.explode(F.array("src", "dst")).alias("node"))
    elif strategy == "shared_neighbors":
        pairs = walks.select(*GROUP, F.posexplode("path").alias("pos", "src"), "path").withColumn("dst", F.get("path", F.col("pos") + 1)).select(*GROUP, "src", "dst")
        first = pairs.join(edges.select(*GROUP, "src", F.col("dst").alias("via")), [*GROUP, "src"])
        out = on.union(first.join(edges.select(*GROUP, F.col("src").alias("via"), "dst"), [*GROUP, "via", "dst"], "left_semi").select(*GROUP, "via"))
    else:
        either = edges.select(*GROUP, F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select(*GROUP, "dst", "src"))
        out = on
        for _ in range({"1-hop": 1, "2-hop": 2}[strategy]):
            out = out.union(out.join(either, [*GROUP, "node"]).select(*GROUP, "next")).distinct()
    return out.union(out.select(*GROUP, complement(F.col("node")))).distinct()


def find_paths(edges: DataFrame, s: Strategy) -> DataFrame:
    """Walks peeled off every group, until what is left of it is too small or its best walk too short: component, hap, number,
    path.

    All groups are worked on at once; a round takes the longest walk of each (of equals, the first start's) and removes what
    that uses up. edges: as for ``walks_through``.
    """
    spark, found, number = edges.sparkSession, new_folder(edges.sparkSession, "paths"), 0
    ends = lambda e: e.select(*GROUP, F.explode(F.array("src", "dst")).alias("node")).distinct()
    edges, nodes = written(edges, "paths-edges"), written(ends(edges), "paths-nodes")
    graph, gone = search_graph(edges), None
    while True:
        large = nodes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.min_path_length).select(*GROUP)
        edges = written(edges.join(large, GROUP, "left_semi"), "paths-edges")
        starts = written(sampled_starts(edges, s, number), "paths-starts")
        walks = walks_through(starts, edges, s, graph, gone)
        best = walks.groupBy(*GROUP).agg(F.min_by(F.struct("path", "length"), F.struct(-F.col("length"), "search")).alias("w")).select(*GROUP, "w.path", "w.length")
        best = written(best.where(F.col("length") >= s.min_walk_length).select(*GROUP, F.lit(number).alias("number"), "path"), "paths-best")
        best.write.mode("append").parquet(found)
        if best.isEmpty():
            return spark.read.schema(best.schema).parquet(found)
        used = written(used_up(best, edges, s.visited), "paths-gone")
        gone = used if gone is None else written(gone.union(used), "paths-gone")
        nodes = written(nodes.join(best, GROUP, "left_semi").join(used, [*GROUP, "node"], "left_anti"), "paths-nodes")
        alive = lambda end: nodes.withColumnRenamed("node", end)  # noqa: E731, B023
        edges = written(edges.join(alive("src"), [*GROUP, "src"], "left_semi").join(alive("dst"), [*GROUP, "dst"], "left_semi"), "paths-edges")
        number += 1


def scored_components(nodes: DataFrame, edges: DataFrame, s: Strategy, haps: list[str] | None = None) -> DataFrame:
    """Edges that the search sees: component, hap, src, dst, prefix_length, src_length, dst_length, gain.

    edges: src, dst, overlap_length, prefix_length, score, to_cut; nodes: node, read_length, kmer_count_p, kmer_count_m (and
    graphic_score). Without haplotypes no k-mers are penalised.
    """
    kept = written(double_cut(edges, s.c_t, s.c_b), "scored-kept")
    members = find_components(kept, s.min_component_size)
    own = kept.join(members.withColumnRenamed("node", "src"), "src")
    has_kmers = {"kmer_count_p", "kmer_count_m"} <= set(nodes.columns)
    more = ["graphic_score"] if "graphic_score" in nodes.columns else []
    kmers = ["kmer_count_p", "kmer_count_m"] if has_kmers else []
    src = nodes.select(F.col("node").alias("src"), F.col("read_length").alias("src_length"))
    dst = nodes.select(F.col("node").alias("dst"), F.col("read_length").alias("dst_length"), *kmers, *more)
    rows = own.join(src, "src").join(dst, "dst")
    rows = rows.withColumn("hap", F.explode(F.array(*(F.lit(h) for h in haps)))) if haps else rows.withColumn("hap", F.lit("h"))
    if s.graphic:
        graphic = F.when(F.col("hap") == "m", -F.col("graphic_score")).otherwise(F.col("graphic_score"))
        gain = graphic_edge_score(F.col("dst_length"), F.col("overlap_length"), graphic, F.col("score"), s.alpha, s.beta, s.gamma, s.graphic_threshold)
    else:
        wrong = F.when(F.col("hap") == "p", F.col("kmer_count_m")).when(F.col("hap") == "m", F.col("kmer_count_p")) if has_kmers else F.lit(None).cast("double")
        gain = beam_edge_score(F.col("dst_length"), F.col("overlap_length"), wrong, F.col("score"), s.alpha, s.beta, s.gamma)
    # multiples of 2^-20: their sums are exact, so they don't depend on the order of addition
    return rows.select("component", "hap", "src", "dst", "prefix_length", "src_length", "dst_length", (F.rint(gain * (1 << 20)) / (1 << 20)).alias("gain"))


def get_walks(nodes: DataFrame, edges: DataFrame, s: Strategy = STRATEGIES["beam"], haps: list[str] | None = None) -> DataFrame:
    """The whole decoding: hap, walk_id (the component's label and the walk's number in it), pos, node."""
    paths = find_paths(scored_components(nodes, edges, s, haps), s)
    walk_id = F.concat_ws(".", F.col("component").cast("string"), F.col("number").cast("string"))
    return paths.select("hap", walk_id.alias("walk_id"), F.posexplode("path").alias("pos", "node"))


def beam_walks(nodes: DataFrame, edges: DataFrame, s: Strategy, haps: list[str] | None = None) -> DataFrame:
    """Of each component and haplotype the best beam from its smallest node: hap, component, n_nodes, length, gain."""
    own = written(scored_components(nodes, edges, s, haps), "beam-scored")
    first = own.groupBy(*GROUP).agg(F.min(F.least("src", "dst")).alias("node"))
    starts = first.select(*GROUP, F.lit(0).alias("search"), F.lit(False).alias("backward"), "node")
    walks, _ = beam_search(starts, search_graph(own), s.beam_width, starts.select(*SEARCH, "node").limit(0), s.beam_intermediate)
    return walks.select("hap", "component", F.size("path").alias("n_nodes"), "length", F.col("total").alias("gain"))
