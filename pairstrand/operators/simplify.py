"""Simplification: self edges, transitive edges, condensation of unbranching chains, renumbering, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.functions.strings import complement
from pairstrand.operators.graph import mirror_semi, two_steps
from pairstrand.sources.shared import forget, shuffle_partitions, written

EPS = 0.12


#: Ranges that a pass of ``order_statistics`` counts for a rank.
RANGES = 1024


def drop_self_compl(edges: DataFrame) -> DataFrame:
    """Without edges from a node to itself or to its complement."""
    return edges.where((F.col("src") != F.col("dst")) & (F.col("src") != complement(F.col("dst"))))


def triangle_theta(edges: DataFrame, eps: float = EPS) -> DataFrame:
    """Transitive edges: those with a two-step way whose prefix lengths add up to about their own.

    Marks are made on the whole graph, and kept if the mirror is marked too.
    """
    lo, hi, own, way = F.lit(1 - eps), F.lit(1 + eps), F.col("prefix_length"), F.col("first_prefix_length") + F.col("second_prefix_length")
    near = ((own * lo <= way) & (way <= own * hi)) | ((way * lo <= own) & (own <= way * hi))
    return mirror_semi(two_steps(edges, ["prefix_length"]).where(near).select("src", "dst").distinct())


def transitive_reduction(edges: DataFrame, eps: float = EPS) -> DataFrame:
    edges = written(edges, "reduction-edges")  # ways of two edges look at them time and again
    return edges.join(triangle_theta(edges, eps), ["src", "dst"], "left_anti")


def linear_edges(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their destination."""
    one_out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src")
    one_in = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("dst")
    return edges.join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").where(F.col("dst") != complement(F.col("src"))).select("src", "dst")


def chains(edges: DataFrame) -> DataFrame:
    """Maximal chains of linear edges: head, node, pos (0 at the head). Pure cycles have no head and are left out."""
    return chains_of(linear_edges(edges))


def chains_of(lin: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """Chains of edges (src, dst) of which no two begin or end alike: head, node, pos, and the sums of some of the edges' columns from
    the head to the node.

    Pointer doubling: each round a node looks at the ancestor of its ancestor, so rounds follow the logarithm of the
    longest chain. What still moves when a pointer reaches further than all nodes together lies on a cycle.
    """
    lin = written(lin.select("src", "dst", *sums), "chain-linear")
    members = lin.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n_members = members.count()
    step = lin.select(F.col("dst").alias("node"), F.col("src").alias("up"), *sums)
    state = members.join(step, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("pos"), *(F.coalesce(c, F.lit(0)).alias(c) for c in sums))
    state, rounds = written(state, "chain-state"), 0
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("pos").alias("more"), *(F.col(c).alias(f"more_{c}") for c in sums))
        nxt = state.join(above, "up").select("node", F.col("next").alias("up"), F.col("up").alias("old"), (F.col("pos") + F.col("more")).alias("pos"), *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums))
        nxt = written(nxt, "chain-state")
        forget(state)
        state, rounds = nxt, rounds + 1
        if 1 << rounds >= n_members or nxt.where(F.col("up") != F.col("old")).isEmpty():
            break
    heads = members.join(lin.select(F.col("dst").alias("node")), "node", "left_anti").select(F.col("node").alias("up"))
    return state.join(heads, "up", "left_semi").select(F.col("up").alias("head"), "node", "pos", *sums)


def chain_pairs(chain: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Of each chain and its mirror, the one whose head has the smaller id: head, node, pos, n (nodes of the chain).

    A chain that shares a node with its own mirror is dropped, as are those of ``max_nodes`` nodes or more, if that is given.
    """
    sizes = chain.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "pos").alias("tail"))
    twin = chain.select("head", complement(F.col("node")).alias("node")).join(chain.select("node", F.col("head").alias("other")), "node").where("head = other").select("head").distinct()
    kept = sizes.where(F.col("head") < complement(F.col("tail"))).join(twin, "head", "left_anti")
    if max_nodes is not None:
        kept = kept.where(F.col("n") < max_nodes)
    return chain.join(kept.select("head", "n"), "head")


def chain_rollup(chain: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Attributes of merged chains: read_length (lengths less overlaps), support (mean weighted by length), n, starts and
    ends per haplotype (the least start and largest end), chromosome and strand (the most common; of equals the least)."""
    following = chain.select("head", F.col("node").alias("src"), "pos").join(edges.select("src", "dst", "overlap_length"), "src")
    inside = following.join(chain.select("head", F.col("node").alias("dst"), F.col("pos").alias("next")), ["head", "dst"]).where("next = pos + 1")
    overlaps = inside.groupBy("head").agg(F.sum("overlap_length").alias("overlaps"))
    rows = chain.join(nodes, "node")
    length = F.col("read_length")
    with_support = F.when(F.col("support").isNotNull(), length)
    merged = rows.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("total"),
        (F.sum(F.col("support") * length) / F.sum(with_support)).alias("support"),
        *(F.min(f"read_start_{h}").alias(f"start_{h}") for h in "MP"),
        *(F.max(f"read_end_{h}").alias(f"end_{h}") for h in "MP"),
        F.mode("read_chr", True).alias("read_chr"),
        F.mode("read_strand", True).alias("read_strand"),
    )
    return merged.join(overlaps, "head", "left").select(
        "head", "n", (F.col("total") - F.coalesce("overlaps", F.lit(0))).alias("read_length"), F.round("support", 6).alias("support"),
        "start_M", "end_M", "start_P", "end_P", "read_chr", "read_strand",
    )


def infer_chain_coords(chain: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Coordinates that the first and the last node of chains lack, from the nearest node of the chain that has some: head, node,
    place (first or last), reference (that node), and start and end per haplotype (null where nothing follows).

    The distance from a reference is the length that all nodes from the one to the other spell, both of them included. An end
    that has both haplotypes' coordinates needs none and gives no row, as does one without a reference.
    """
    along = Window.partitionBy("head").orderBy("pos")
    coordinates = [f"read_{w}_{h}" for h in "MP" for w in ("start", "end")]
    rows = chain.select("head", "node", "pos").join(nodes.select("node", "read_length", *coordinates), "node")
    rows = rows.withColumns({"next": F.lead("node").over(along), "last": F.max("pos").over(Window.partitionBy("head"))})
    rows = rows.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "overlap_length"), ["node", "next"], "left")
    added = F.col("read_length") - F.coalesce("overlap_length", F.lit(0))
    rows = rows.withColumn("before", F.coalesce(F.sum(added).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    has = lambda h: F.col(f"read_start_{h}").isNotNull() & F.col(f"read_end_{h}").isNotNull()
    known, whole = has("M") | has("P"), has("M") & has("P")
    what = F.struct("node", "read_length", "before", *(F.when(has(h), F.col(f"read_start_{h}")).alias(h) for h in "MP"))
    at = lambda place, ends, beyond, nearest: rows.groupBy("head").agg(
        F.max(F.when(ends, what)).alias("own"), F.bool_or(ends & whole).alias("whole"), nearest(F.when(known & beyond, what), F.when(known & beyond, F.col("pos"))).alias("ref"), F.lit(place).alias("place"),
        *(F.bool_or(ends & has(h)).alias(f"has_{h}") for h in "MP"),
    )
    first = at("first", F.col("pos") == 0, F.col("pos") > 0, F.min_by)
    last = at("last", F.col("pos") == F.col("last"), F.col("pos") < F.col("last"), F.max_by)
    both = first.union(last).where("not whole and ref is not null")
    span = F.when(F.col("place") == "first", F.col("own.before") - F.col("ref.before") - F.col("ref.read_length")).otherwise(F.col("own.before") + F.col("own.read_length") - F.col("ref.before"))
    start = lambda h: F.when(~F.col(f"has_{h}"), F.col(f"ref.{h}") + span)
    out = [x for h in "MP" for x in (start(h).alias(f"start_{h}"), (start(h) + F.col("own.read_length")).alias(f"end_{h}"))]
    return both.select("head", F.col("own.node").alias("node"), "place", F.col("ref.node").alias("reference"), *out)


def condense(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge chains in pairs of mirrors: new nodes (node, read_length, support), new edges, and members (node, old, pos).

    The i-th chain, by its head, becomes node ``base + 2 i`` and its mirror ``base + 2 i + 1``, where base is the least even
    number above all ids. Edges into heads and out of tails survive; prefix lengths are computed anew.
    """
    pairs = written(chain_pairs(chains(drop_self_compl(edges)), max_nodes), "condense-chains")
    base = (nodes.agg(F.max("node").alias("m")).first()["m"] or 0) // 2 * 2 + 2
    heads = _numbered(pairs.select("head").distinct(), "head").select("head", (F.lit(base) + 2 * F.col("number")).alias("new"))
    numbered = pairs.join(heads, "head")
    members = written(
        numbered.select(F.col("new").alias("node"), F.col("node").alias("old"), "pos").union(numbered.select(F.col("new") + 1, complement(F.col("node")), F.col("n") - 1 - F.col("pos"))), "condense-members"
    )
    single = nodes.join(members.select(F.col("old").alias("node")), "node", "left_anti").select("node", "read_length", "support")
    rolled = chain_rollup(pairs, nodes, edges).join(heads, "head")
    merged = rolled.select(F.explode(F.array("new", F.col("new") + 1)).alias("node"), "read_length", "support")
    new_nodes = single.unionByName(merged)
    to = members.select("old", F.col("node").alias("to"), "pos")
    last = to.groupBy("to").agg(F.max("pos").alias("last"))
    ends = to.join(last, "to")
    src = ends.where("pos = last").select(F.col("old").alias("src"), F.col("to").alias("new_src"))
    dst = ends.where("pos = 0").select(F.col("old").alias("dst"), F.col("to").alias("new_dst"))
    inner_src, inner_dst = ends.where("pos < last").select(F.col("old").alias("src")), ends.where("pos > 0").select(F.col("old").alias("dst"))
    kept = drop_self_compl(edges).join(inner_src, "src", "left_anti").join(inner_dst, "dst", "left_anti").join(src, "src", "left").join(dst, "dst", "left")
    moved = kept.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "overlap_length")
    return new_nodes, prefix_lengths(moved, new_nodes), members


def prefix_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with prefix_length, the source's length less the overlap."""
    lengths = nodes.select(F.col("node").alias("src"), "read_length")
    return edges.drop("prefix_length").join(lengths, "src").withColumn("prefix_length", F.col("read_length") - F.col("overlap_length")).drop("read_length")


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """Number rows by a column from 0: by ranges, with a prefix sum over one count per range."""
    ranged = written(df.repartitionByRange(shuffle_partitions(df.sparkSession), column).withColumn("range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return ranged.join(bases, "range").withColumn("number", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1).drop("range", "base")


def reindex(nodes: DataFrame) -> DataFrame:
    """Dense ids that keep pairs together: node, new_node."""
    pair = nodes.select(F.expr("node div 2").alias("pair")).distinct()
    numbered = _numbered(pair, "pair").select("pair", "number")
    return nodes.select("node", F.expr("node div 2").alias("pair")).join(numbered, "pair").select("node", (2 * F.col("number") + F.col("node").bitwiseAND(F.lit(1))).alias("new_node"))


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of a numeric column, exactly: nulls and NaN aside.

    Each pass counts the values of every rank's range in ``RANGES`` narrower ones and goes on with the one that holds the rank, until
    that holds a single value. So a task keeps counts only, and the driver sees ``RANGES`` rows a rank and pass.
    """
    value = rows.select(F.col(column).cast("double").alias("v")).where(~F.isnan("v"))
    low, high = value.agg(F.min("v"), F.max("v")).first()
    open_, out = {r: (low, high, 0) for r in set(ranks)}, {}
    while open_:
        cases = [F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.struct(F.lit(r).alias("rank"), F.least(F.floor((F.col("v") - lo) / ((hi - lo) or 1.0) * RANGES), F.lit(RANGES - 1)).alias("range"))) for r, (lo, hi, _) in open_.items()]
        seen = value.select("v", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x"))
        counts = seen.groupBy("x.rank", "x.range").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        after = {}
        for r, (_, _, before) in open_.items():
            for c in sorted((c for c in counts if c["rank"] == r), key=lambda c: c["range"]):
                if before + c["n"] > r:
                    if c["lo"] == c["hi"]:
                        out[r] = c["lo"]
                    else:
                        after[r] = (c["lo"], c["hi"], before)
                    break
                before += c["n"]
        open_ = after
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles, exactly; None without values."""
    n = rows.select(F.col(column).cast("double").alias("v")).where("not isnan(v)").count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = order_statistics(rows, column, [k for p in places for k in (int(p), min(int(p) + 1, n - 1))])
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def edge_stats(edges: DataFrame, column: str) -> DataFrame:
    """count, mean, std (population), min, max, median and quartiles (interpolated) of a column."""
    c = F.col(column)
    edges = written(edges.select(column), "stats-values")  # every pass reads this column alone
    q = quantiles(edges, column, [0.25, 0.5, 0.75])
    stats = edges.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return stats.select("*", *(F.lit(v).cast("double").alias(name) for v, name in zip(q, ("p25", "median", "p75"), strict=True)))


def attr_coverage(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, present, percent, level (poor under 50, fair 70, good 95, else full)."""
    counted = nodes.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in columns))
    rows = counted.unpivot(["total"], columns, "attribute", "present")
    percent = 100 * F.col("present") / F.col("total")
    level = F.when(percent < 50, "poor").when(percent < 70, "fair").when(percent < 95, "good").otherwise("full")
    return rows.select("attribute", "present", F.round(percent, 6).alias("percent"), level.alias("level"))


def support_fill(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, support: where it's missing, the mean of all neighbours' support, else 0."""
    either = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    near = either.join(nodes.select(F.col("node").alias("other"), F.col("support").alias("s")), "other").groupBy("node").agg(F.avg("s").alias("mean"))
    return nodes.join(near, "node", "left").select("node", F.round(F.coalesce("support", "mean", F.lit(0.0)), 6).alias("support"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong with a graph: check, n."""
    from pairstrand.operators.graph import edge_integrity, mirror_anti, missing_complements

    bad = {"edges_without_nodes": edge_integrity(nodes, edges), "nodes_without_complement": missing_complements(nodes), "edges_without_mirror": mirror_anti(edges)}
    out = None
    for what, rows in bad.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("check"), "n")
        out = one if out is None else out.union(one)
    return out


def is_synthetic(nodes: DataFrame, sample: int = 10) -> bool:
    """Whether nodes have true coordinates: the columns are there, and most of the first nodes have a chromosome."""
    wanted = {f"read_{w}_{h}" for w in ("start", "end") for h in "MP"} | {"read_chr", "read_strand"}
    if not wanted <= set(nodes.columns):
        return False
    first = nodes.orderBy("node").limit(sample).agg(F.count("read_chr").alias("known"), F.count(F.lit(1)).alias("n")).first()
    return first["known"] > first["n"] // 2


def simplify(nodes: DataFrame, edges: DataFrame, eps: float = EPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transitive reduction, then condensation; raises on a graph that isn't mirror-symmetric."""
    from pairstrand.operators.graph import assert_invariants

    clean = written(drop_self_compl(edges).select("src", "dst", "overlap_length", "prefix_length"), "simplify-edges")
    assert_invariants(nodes, clean)
    new_nodes, new_edges, members = condense(nodes, written(transitive_reduction(clean, eps), "simplify-reduced"))
    new_edges = written(new_edges, "simplify-condensed")
    assert_invariants(new_nodes, new_edges)
    return new_nodes, new_edges, members
