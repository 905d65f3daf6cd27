"""Ground-truth labels of edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.functions.predicates import edge_class, is_correct_edge
from pairstrand.operators.graph import attach_endpoint_attrs
from pairstrand.sources.shared import new_folder, written

COORDINATES = ["read_start_M", "read_end_M", "read_start_P", "read_end_P"]


def classify_edges(edges: DataFrame, nodes: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """src, dst, read_chr (of the source), class, and more columns of both ends' attributes (s_* and d_*)."""
    known = ["node", "read_chr", "read_strand", *COORDINATES]
    extra = [c for c in nodes.columns if c not in known] if more else []
    both = attach_endpoint_attrs(edges if more else edges.select("src", "dst"), nodes, [*known[1:], *extra])
    return both.select("src", "dst", F.col("s_read_chr").alias("read_chr"), edge_class().alias("class"), *(c.alias(n) for n, c in (more or {}).items()))


def label_columns(cls: Column) -> dict[str, Column]:
    """The label columns that follow from an edge's class."""
    flag = lambda *names: cls.isin(*names).cast("int")
    return {
        "gt_bin": flag("correct"),
        "dead_end": F.lit(0),
        "cross_chr": flag("cross_chr"),
        "cross_strand": flag("cross_strand"),
        "skip": flag("forward_skip", "backward_skip"),
        "forward_skip": flag("forward_skip"),
        "backward_skip": flag("backward_skip"),
        "unknown": flag("unknown"),
        "malicious": flag("cross_chr", "cross_strand"),
        "gt_no_deadend": flag("cross_chr", "cross_strand", "forward_skip", "backward_skip"),
        "single_chrom_bad": flag("cross_strand", "forward_skip", "backward_skip", "unknown"),
        "importance_weight": F.when(cls == "cross_strand", 10.0).when(cls == "unknown", 0.1).otherwise(1.0),
    }


def create_gt(edges: DataFrame, nodes: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Every edge with its label columns, and more as for ``classify_edges``."""
    classified = classify_edges(edges, nodes, more)
    return classified.select("src", "dst", *(c.alias(n) for n, c in label_columns(F.col("class")).items()), *(more or {}))


def gt_soft(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """gt_bin_soft: 0.7 for edges that are wrong, not malicious, and lead to a homozygous node; else gt_bin."""
    region = nodes.select(F.col("node").alias("dst"), F.col("yak_region").alias("region"))
    soft = (F.col("gt_bin") == 0) & (F.col("region") == "O") & (F.col("malicious") == 0)
    return labelled.join(region, "dst").select("src", "dst", F.when(soft, 0.7).otherwise(F.col("gt_bin").cast("double")).alias("gt_bin_soft"))


def gt_no_hap(edges: DataFrame, nodes: DataFrame, hap: str = "M") -> DataFrame:
    """Correctness by one coordinate system, of edges within one variant."""
    both = attach_endpoint_attrs(edges.select("src", "dst"), nodes, ["variant", "read_strand", f"read_start_{hap}", f"read_end_{hap}"])
    col = lambda end, what: F.col(f"{end}_read_{what}_{hap}")
    right = is_correct_edge(col("s", "start"), col("s", "end"), col("d", "start"), col("d", "end"), F.col("s_read_strand"))
    return both.select("src", "dst", ((F.col("s_variant") == F.col("d_variant")) & right).cast("int").alias("gt"))


def trio_labels(nodes: DataFrame) -> DataFrame:
    """yak_p, yak_m, ambiguous, yak_region and k-mer counts (thousands) from a trio-binning label."""
    label = F.col("trio_label")
    pick = lambda p, m, zero, a: F.when(label == "p", p).when(label == "m", m).when(label == "0", zero).when(label == "a", a)
    return nodes.select(
        "node",
        pick(1, -1, 0, 0).alias("yak_p"),
        pick(-1, 1, 0, 0).alias("yak_m"),
        pick(0, 0, 0, 1).alias("ambiguous"),
        pick("E", "E", "O", "O").alias("yak_region"),
        (F.col("strong_pat") / 1000).alias("kmer_count_p"),
        (F.col("strong_mat") / 1000).alias("kmer_count_m"),
    )


def label_distribution(labelled: DataFrame, column: str) -> DataFrame:
    """Count and share (per cent) of each value of a column."""
    counts = labelled.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def edge_class_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("read_chr", "class").agg(F.count(F.lit(1)).alias("n"))


def trap_edges(labelled: DataFrame) -> DataFrame:
    """src, dst, trap: edges into nodes all of whose (one or more) out-edges are wrong or traps themselves.

    Repeated until nothing changes; a round writes what it adds to the shared folder. A node with a single way on shares the fate
    of the node it leads to, so such chains are first followed by pointer doubling and rounds count the other nodes only.
    """
    edges = written(labelled.select("src", "dst", (F.col("gt_bin") == 0).alias("wrong")), "traps")
    on = F.when(~F.col("wrong"), F.col("dst"))
    single = edges.groupBy("src").agg(F.min(on).alias("next"), F.max(on).alias("other"), F.bool_or(F.col("wrong").isNull()).alias("vague")).where("next = other and not vague")
    links, before = written(single.select(F.col("src").alias("node"), "next"), "trap-links"), None
    while True:
        ahead = links.select(F.col("node").alias("next"), F.col("next").alias("after"))
        moved = written(links.join(ahead, "next", "left").select("node", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moving")), "trap-links")
        links, moving = moved.select("node", "next"), moved.where("moving").count()
        if moving in (0, before):  # what never arrives runs into a cycle, which has no end
            break
        before = moving
    aimed = edges.join(links.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", "wrong", F.coalesce("next", "dst").alias("aim"))
    aimed = written(aimed, "traps")
    state = aimed.join(links.select(F.col("node").alias("src")), "src", "left_anti")
    # a node is dead once all its right edges lead to dead ones; of edges that are neither right nor wrong one is enough, where there are no others
    right, bad = F.count_if(~F.col("wrong")), F.coalesce(F.bool_or("wrong"), F.lit(False))
    needs = state.groupBy("src").agg(F.when(right > 0, right).when(bad, 0).otherwise(1).alias("need"), (right > 0).alias("has_right"))
    needs = written(needs, "trap-needs")
    dead = _dead(written(state.where(~F.col("wrong")).select("src", "aim").union(state.where("wrong is null").join(needs.where("need = 1 and not has_right").select("src"), "src", "left_semi").select("src", "aim")), "trap-open"), needs)
    return aimed.join(dead.withColumn("dead", F.lit(True)), "aim", "left").select("src", "dst", F.coalesce("dead", F.lit(False)).cast("int").alias("trap"))


def _dead(open_edges: DataFrame, needs: DataFrame) -> DataFrame:
    """Dead nodes (aim): those of which at least ``need`` edges (src, aim) lead to dead ones. A round writes the nodes that it adds,
    and how many edges lead to them from where."""
    spark, c = needs.sparkSession, F.col
    dead, hits, rounds = new_folder(spark, "trap-dead"), new_folder(spark, "trap-hits"), 0
    needs.where("need = 0").select(c("src").alias("aim")).write.parquet(f"{dead}/n=0")
    while True:
        front = spark.read.schema("aim long").parquet(f"{dead}/n={rounds}")
        rounds += 1
        open_edges.join(front, "aim").groupBy("src").agg(F.count(F.lit(1)).alias("hits")).write.parquet(f"{hits}/n={rounds}")
        now = spark.read.schema("src long, hits long").parquet(f"{hits}/n={rounds}")
        every = spark.read.schema("src long, hits long").parquet(hits)
        sums = every.join(now.select("src", c("hits").alias("now")), "src").groupBy("src").agg(F.sum("hits").alias("all"), F.max("now").alias("now"))
        new = sums.join(needs, "src").where((c("all") >= c("need")) & (c("all") - c("now") < c("need")))
        new.select(c("src").alias("aim")).write.parquet(f"{dead}/n={rounds}")
        if spark.read.schema("aim long").parquet(f"{dead}/n={rounds}").isEmpty():
            return spark.read.schema("aim long").parquet(dead).select("aim")


def node_outcomes(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without out-edges, with only wrong ones, and others: outcome, n."""
    outs = labelled.groupBy(F.col("src").alias("node")).agg(F.max("gt_bin").alias("best"))
    outcome = F.when(F.col("best").isNull(), "no_out_edge").when(F.col("best") == 0, "only_wrong").otherwise("some_correct")
    return nodes.select("node").join(outs, "node", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def unitig_rollup(placements: DataFrame, reads: DataFrame) -> DataFrame:
    """Unitigs from their reads: seg_id, n, read_strand, read_chr, variant, and start, end and number of reads per variant.

    placements: line_no, seg_id, orient, read_id; reads: read_id, read_strand, read_chr, variant, read_start, read_end. The
    strand is the sign of the strands as placed (0 counts as +1); chromosome and variant are the most common ones, of equals
    the one that comes first in the file.
    """
    rows = written(placements.select("seg_id", "line_no", "orient", "read_id").join(reads.select("read_id", "read_strand", "read_chr", "variant", "read_start", "read_end"), "read_id").drop("read_id"), "unitig-rows")
    placed = F.col("read_strand") * F.when(F.col("orient") == "-", -1).otherwise(1)
    merged = rows.groupBy("seg_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.sum(placed) >= 0, 1).otherwise(-1).alias("read_strand"),
        *(F.min(F.when(F.col("variant") == v, F.col("read_start"))).alias(f"start_{v}") for v in "MP"),
        *(F.max(F.when(F.col("variant") == v, F.col("read_end"))).alias(f"end_{v}") for v in "MP"),
        *(F.count_if(F.col("variant") == v).alias(f"n_{v}") for v in "MP"),
    )
    for name in ("read_chr", "variant"):
        counts = rows.groupBy("seg_id", name).agg(F.count(F.lit(1)).alias("c"), F.min("line_no").alias("first"))
        merged = merged.join(counts.groupBy("seg_id").agg(F.max_by(name, F.struct("c", (-F.col("first")).alias("f"))).alias(name)), "seg_id")
    return merged.select("seg_id", "n", "read_strand", "read_chr", "variant", "start_M", "end_M", "start_P", "end_P", "n_M", "n_P")


def complete_unitigs(rolled: DataFrame, m_to_p: DataFrame, p_to_m: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Unitigs whose coordinates agree: seg_id and start and end per haplotype.

    rolled: ``unitig_rollup`` with counts. A haplotype without reads gets the other's coordinates, lifted over. With reads of
    both, and spans that differ by over ``tolerance`` of the longer, the one with fewer reads gets the other's, if both ends can
    be lifted. m_to_p and p_to_m: chain blocks as for ``joins.liftover``.
    """
    from pairstrand.operators.joins import liftover

    out = rolled
    for h, other, blocks in (("M", "P", m_to_p), ("P", "M", p_to_m)):
        for end in ("start", "end"):
            at = rolled.select("seg_id", F.col("read_chr").alias("chr"), F.col(f"{end}_{h}").alias("position")).where("position is not null")
            out = out.join(liftover(at, blocks, "seg_id").select("seg_id", F.col("lifted").alias(f"lifted_{end}_{other}")), "seg_id", "left")
    span = lambda h: F.col(f"end_{h}") - F.col(f"start_{h}")
    apart = (span("M") > 0) & (span("P") > 0) & (F.abs(span("M") - span("P")) / F.greatest(span("M"), span("P")) > tolerance)

    def repaired(h: str, other: str) -> list[Column]:
        lifted = [F.col(f"lifted_{end}_{h}") for end in ("start", "end")]
        fewer = apart & (F.col(f"n_{h}") > 0) & (F.col(f"n_{other}") > F.col(f"n_{h}")) & lifted[0].isNotNull() & lifted[1].isNotNull()
        return [F.when((F.col(f"n_{h}") == 0) | fewer, new).otherwise(F.col(f"{end}_{h}")).alias(f"{end}_{h}") for end, new in zip(("start", "end"), lifted, strict=True)]

    return out.select("seg_id", *repaired("M", "P"), *repaired("P", "M"))


def hg_consensus(placements: DataFrame) -> DataFrame:
    """seg_id, consensus (m, p, or 0 without or with both), mixed: from the reads' haplotype tags."""
    has = lambda v: F.coalesce(F.bool_or(F.col("hg") == v), F.lit(False))
    rows = placements.groupBy("seg_id").agg(has("m").alias("m"), has("p").alias("p"))
    consensus = F.when(F.col("m") & ~F.col("p"), "m").when(F.col("p") & ~F.col("m"), "p").otherwise("0")
    return rows.select("seg_id", consensus.alias("consensus"), (F.col("m") & F.col("p")).cast("int").alias("mixed"))


#: Of a read's length so much overlaps the next read of its unitig where nothing better is known: a tenth, at most so many bases.
OVERLAP_PART, MOST_OVERLAP = 10, 1500


def infer_read_coords(placements: DataFrame, reads: DataFrame) -> DataFrame:
    """Unitigs' reads with the coordinates that some of them lack: seg_id, line_no, read_id, variant, read_start, read_end, inferred.

    placements: seg_id, line_no, offset, read_id; reads: read_id, variant, read_length, read_start, read_end. Among the reads of one
    variant in the order of their offsets, a read without coordinates is placed from the last one before it that has some, by the
    reads' lengths less estimated overlaps; where there is none, from the next one after it. Where all lack them, they stay null.
    """
    along = Window.partitionBy("seg_id", "variant").orderBy("offset", "line_no")
    before, until, after = (along.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (1, Window.unboundedFollowing)))
    rows = placements.select("seg_id", "line_no", "offset", "read_id").join(reads.select("read_id", "variant", "read_length", "read_start", "read_end"), "read_id")
    step = F.col("read_length") - F.least(F.lit(MOST_OVERLAP), F.expr(f"read_length div {OVERLAP_PART}"))
    rows = rows.withColumn("at", F.coalesce(F.sum(step).over(before), F.lit(0)))
    known = F.when(F.col("read_start").isNotNull() & F.col("read_end").isNotNull(), F.struct("read_start", "at"))
    rows = rows.withColumns({"last": F.last(known, True).over(until), "next": F.first(known, True).over(after)})
    lacks = F.col("read_start").isNull() | F.col("read_end").isNull()
    start = F.coalesce(F.col("last.read_start") + F.col("at") - F.col("last.at"), F.col("next.read_start") - (F.col("next.at") - F.col("at")))
    placed = {"read_start": F.when(lacks, start).otherwise(F.col("read_start")), "read_end": F.when(lacks, start + F.col("read_length")).otherwise(F.col("read_end")), "inferred": lacks & start.isNotNull()}
    return rows.withColumns(placed).select("seg_id", "line_no", "read_id", "variant", "read_start", "read_end", "inferred")


def unitig_spans(placed: DataFrame) -> DataFrame:
    """seg_id and the least start and largest end of its reads per variant, inferred ones included."""
    ends = [f(F.when(F.col("variant") == v, F.col(f"read_{w}"))).alias(f"{w}_{v}") for v in "MP" for w, f in (("start", F.min), ("end", F.max))]
    return placed.groupBy("seg_id").agg(*ends)
