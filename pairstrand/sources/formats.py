"""Text formats of assembly graphs, reads and reports: scans into tables, and tables into lines.

Files are scanned line by line with ``spark.read.text`` (gzip by extension). Where the order of lines matters, line numbers
come from ``numbered_lines``, which counts the lines of each block of a file and adds up the counts of the blocks before it.
Malformed records raise an error when they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairstrand.functions.strings import extract_id, header_field, oriented, strand_of
from pairstrand.sources.shared import forget, shuffle_partitions, written

FASTA, FASTQ = ("fasta", "fa", "fna"), ("fastq", "fq")


def filetype(path: str) -> str:
    """``fasta`` or ``fastq``, by extension; ``.gz`` aside."""
    parts = path.lower().rstrip("/").split(".")
    last = parts[-2] if parts[-1] == "gz" and len(parts) > 2 else parts[-1]
    for kind, names in (("fasta", FASTA), ("fastq", FASTQ)):
        if last in names:
            return kind
    raise ValueError(f"{path}: neither FASTA nor FASTQ by its extension")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, file_line (from 0 in each file), line_no (from 0, files in the order of their paths), value."""
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.text(path).select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # a block is read by one task, line after line, so its ids are consecutive
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", before(Window.orderBy("file")).alias("files_before"))
    placed = blocks.withColumn("blocks_before", before(Window.partitionBy("file").orderBy("block"))).join(files, "file")
    found = lines.join(placed.select("file", "block", "first", "blocks_before", "files_before"), ["file", "block"])
    file_line = F.col("blocks_before") + F.col("id") - F.col("first")
    return found.select("file", file_line.alias("file_line"), (F.col("files_before") + file_line).alias("line_no"), "value")


def fields(lines: DataFrame) -> DataFrame:
    """Lines split at white space (f), blank lines left out."""
    return lines.where(F.length(F.trim("value")) > 0).withColumn("f", F.split(F.trim("value"), r"\s+"))


def _need(condition: Column, value: Column, what: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join("f", " "))))


def scan_gfa_s(split: DataFrame, depth: int = 1) -> DataFrame:
    """Segments: seg_id, seq, length, support (per ``depth``). A sequence ``*`` is given as so many stars."""
    f, n = F.col("f"), F.size("f")
    rows = split.where(F.get("f", F.lit(0)) == "S")
    tag = F.filter("f", lambda x: x.startswith("LN:i:"))[0]
    length = F.coalesce(F.substring(tag, 6, 20).cast("long"), F.length(F.get(f, F.lit(2))).cast("long"))
    support = F.when(n >= 5, F.element_at(F.split(F.get(f, F.lit(4)), ":"), -1).cast("double") / depth)
    seq = F.get(f, F.lit(2))
    return rows.select(
        _need(n.between(4, 6), F.get(f, F.lit(1)), "a segment of other than 4 to 6 fields").alias("seg_id"),
        F.when(seq == "*", F.repeat(F.lit("*"), length.cast("int"))).otherwise(seq).alias("seq"),
        length.alias("length"),
        support.alias("support"),
    )


def scan_gfa_l(split: DataFrame) -> DataFrame:
    """Links: id1, orient1, id2, orient2, overlap_length. Lines of seven fields have ids with a ``:from-to`` end."""
    f, n = F.col("f"), F.size("f")
    bare = lambda k: F.when(n == 7, F.regexp_replace(F.get(f, F.lit(k)), r":\d-\d*$", "")).otherwise(F.get(f, F.lit(k)))
    cigar = F.get(f, F.lit(5))
    overlap = F.expr("try_cast(left(get(f, 5), length(get(f, 5)) - 1) as bigint)")
    return split.where(F.get("f", F.lit(0)) == "L").select(
        _need(n.between(6, 8), bare(1), "a link of other than 6 to 8 fields").alias("id1"),
        F.get(f, F.lit(2)).alias("orient1"),
        bare(3).alias("id2"),
        F.get(f, F.lit(4)).alias("orient2"),
        _need(cigar.isNotNull() & overlap.isNotNull(), overlap, "a link without a whole overlap").alias("overlap_length"),
    )


def scan_gfa_a(split: DataFrame, prefix: str = "utg") -> DataFrame:
    """Placements of reads in unitigs: line_no, seg_id, offset, orient, read_id, hg."""
    f = F.col("f")
    hg = F.regexp_extract(F.coalesce(F.get(f, F.lit(8)), F.lit("")), "HG:A:(.)", 1)
    return split.where((F.get(f, F.lit(0)) == "A") & F.get(f, F.lit(1)).startswith(prefix)).select(
        "line_no", F.get(f, F.lit(1)).alias("seg_id"), F.get(f, F.lit(2)).cast("long").alias("offset"), F.get(f, F.lit(3)).alias("orient"), F.get(f, F.lit(4)).alias("read_id"), F.nullif(hg, F.lit("")).alias("hg")
    )


def scan_final_asm(placements: DataFrame) -> DataFrame:
    """Neighbouring reads of contigs: seg_id, read_a, orient_a, read_b, orient_b, prefix (difference of offsets)."""
    along = Window.partitionBy("seg_id").orderBy("offset", "line_no")
    nxt = lambda c: F.lead(c).over(along)
    rows = placements.select("seg_id", F.col("read_id").alias("read_a"), F.col("orient").alias("orient_a"), nxt("read_id").alias("read_b"), nxt("orient").alias("orient_b"), (nxt("offset") - F.col("offset")).alias("prefix"))
    return rows.where(F.col("read_b").isNotNull())


def segment_edges(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links as edges in both directions: src, dst, overlap_length, prefix_length. segments: seg_id, index, length.

    The pair of index i has the nodes 2 i (as written) and 2 i + 1 (its complement).
    """
    at = lambda k: segments.select(F.col("seg_id").alias(f"id{k}"), F.col("index").alias(f"i{k}"), F.col("length").alias(f"n{k}"))
    both = links.join(at(1), "id1").join(at(2), "id2")
    src, dst = oriented(F.col("i1"), F.col("orient1")), oriented(F.col("i2"), F.col("orient2"))
    one = F.lit(1)
    forward = both.select(src.alias("src"), dst.alias("dst"), "overlap_length", (F.col("n1") - F.col("overlap_length")).alias("prefix_length"))
    back = both.select(dst.bitwiseXOR(one).alias("src"), src.bitwiseXOR(one).alias("dst"), "overlap_length", (F.col("n2") - F.col("overlap_length")).alias("prefix_length"))
    return forward.unionByName(back).dropDuplicates(["src", "dst"])


def parse_headers(headers: DataFrame, column: str = "description") -> DataFrame:
    """Simulated reads' headers with read_strand, read_start, read_end, variant and read_chr; missing fields are null."""
    h = F.col(column)
    return headers.select(
        "*",
        strand_of(h).alias("read_strand"),
        header_field(h, "start", "bigint").alias("read_start"),
        header_field(h, "end", "bigint").alias("read_end"),
        header_field(h, "variant", "string").alias("variant"),
        header_field(h, "chr", "string").alias("read_chr"),
    )


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a FASTA file: read_id, description, seq (lines joined)."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r"))
    header, body = F.substring_index("r", "\n", 1), F.expr("substring(r, length(substring_index(r, '\\n', 1)) + 2)")
    rows = records.where(F.length(F.trim("r")) > 0).select(header.alias("header"), F.regexp_replace(body, r"\s+", "").alias("seq"))
    return _reads(rows)


def scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a FASTQ file of four lines a record: read_id, description, seq. Of a record, the first two lines are used."""
    lines = numbered_lines(spark, path).where("file_line % 4 < 2")
    line = lambda k: F.max(F.when(F.col("file_line") % 4 == k, F.col("value")))
    records = lines.groupBy("file", F.expr("file_line div 4")).agg(line(0).alias("header"), line(1).alias("seq"))
    return _reads(records.select(F.expr("substring(header, 2)").alias("header"), "seq"))


def _reads(rows: DataFrame) -> DataFrame:
    header = F.trim("header")
    return rows.select(extract_id(header).alias("read_id"), header.alias("description"), "seq")


def scan_reads(spark: SparkSession, path: str) -> DataFrame:
    return scan_fasta(spark, path) if filetype(path) == "fasta" else scan_fastq(spark, path)


def scan_trio(spark: SparkSession, path: str) -> DataFrame:
    """node, trio_label, strong_pat, strong_mat from a tab-separated k-mer binning report."""
    lines = spark.read.csv(path, sep="\t", schema="node string, trio_label string, strong_pat double, strong_mat double")
    return lines.select(F.regexp_extract("node", r"(\d+)$", 1).cast("long").alias("node"), "trio_label", "strong_pat", "strong_mat")


def scan_yak_eval(lines: DataFrame) -> DataFrame:
    """tag (W, H), rate: of each tag's last line the fourth field."""
    split = fields(lines).select("line_no", F.get("f", F.lit(0)).alias("tag"), F.get("f", F.lit(3)).cast("double").alias("rate"))
    return split.where(F.col("tag").isin("W", "H")).groupBy("tag").agg(F.max_by("rate", "line_no").alias("rate"))


def scan_assembly_report(lines: DataFrame) -> DataFrame:
    """metric, value: NG50, NGA50, Length and Rdup; 0 where missing, the last one where repeated."""
    names = ["NG50", "NGA50", "Length", "Rdup"]
    found = lines.select("line_no", F.regexp_extract("value", r"\b(NG50|NGA50|Length|Rdup)\s+(\d+(?:\.\d+)?)", 1).alias("metric"), F.regexp_extract("value", r"\b(?:NG50|NGA50|Length|Rdup)\s+(\d+(?:\.\d+)?)", 1).alias("v"))
    last = found.where(F.col("metric") != "").groupBy("metric").agg(F.max_by("v", "line_no").cast("double").alias("value"))
    every = lines.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    return every.join(last, "metric", "left").fillna(0.0, ["value"])


def scan_chain(lines: DataFrame) -> DataFrame:
    """Alignment blocks of a chain file: chr, t_start, t_end, q_chr, q_start, q_strand, q_size.

    A ``chain`` line opens a chain; its blocks follow, each with its size and the gaps after it, so a block's place is a
    running sum within its chain: the running sum of all lines less that at the chain's head. Sums run within ranges of lines,
    and a range's starts from those of all before it, so neither the file nor a chain lies in one task.
    """
    num = lambda k: F.coalesce(F.get("f", F.lit(k)).try_cast("long"), F.lit(0))
    rows = fields(lines).select("line_no", "f").withColumn("opens", F.get("f", F.lit(0)) == "chain")
    added = lambda k: F.when(F.col("opens"), F.lit(0)).otherwise(num(0) + num(k))
    rows = running(rows.withColumns({"t": added(1), "q": added(2), "chain": F.col("opens").cast("long")}), "line_no", ["t", "q", "chain"])
    heads = rows.where("opens").select("chain", F.col("t").alias("t_head"), F.col("q").alias("q_head"), *(F.get("f", F.lit(k)).alias(n) for k, n in ((2, "chr"), (5, "t0"), (7, "q_chr"), (8, "q_size"), (9, "q_strand"), (10, "q0"))))
    blocks = rows.where("not opens and chain > 0").select("chain", num(0).alias("size"), (F.col("t") - added(1)).alias("t"), (F.col("q") - added(2)).alias("q"))
    placed = blocks.join(heads, "chain").withColumns({"t": F.col("t") - F.col("t_head"), "q": F.col("q") - F.col("q_head")})
    t_start = F.col("t0").cast("long") + F.col("t")
    return placed.select("chr", t_start.alias("t_start"), (t_start + F.col("size")).alias("t_end"), "q_chr", (F.col("q0").cast("long") + F.col("q")).alias("q_start"), "q_strand", F.col("q_size").cast("long").alias("q_size"))


def running(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Columns replaced by their running sums (each row's included) in the order of a column without ties."""
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "running")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranged.groupBy("range").agg(*(F.sum(c).alias(c) for c in columns)).select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns))
    within = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({c: F.sum(c).over(within) for c in columns}).join(bases, "range")
    return summed.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in columns}).select(rows.columns)


def build_graph(split: DataFrame, reads: DataFrame, depth: int = 1, final: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole graph of a GFA file and its reads: nodes with lengths, support and true coordinates; edges with labels.

    split: ``fields`` of numbered lines; reads: ``parse_headers`` of the reads' headers, with read_id. The pair of the i-th
    segment has the nodes 2 i and 2 i + 1; a unitig's coordinates come from its reads (``labels.unitig_rollup``). With
    ``final``, the neighbouring reads of a final assembly (``scan_final_asm``), edges tell whether it has them
    (hifiasm_result), those between segments of one read each that the graph lacks are added, and so are reads that no
    segment holds.
    """
    from pairstrand.operators.joins import rescue
    from pairstrand.operators.labels import create_gt, unitig_rollup
    from pairstrand.operators.simplify import _numbered

    order = split.where(F.get("f", F.lit(0)) == "S").select("line_no", F.get("f", F.lit(1)).alias("seg_id"))
    segments = scan_gfa_s(split, depth).select("seg_id", "length", "support").join(_numbered(order, "line_no").select("seg_id", F.col("number").alias("index")), "seg_id")
    segments, placements = written(segments, "graph-segments"), written(scan_gfa_a(split), "graph-placements")
    unitigs = segments.join(unitig_rollup(placements, reads), "seg_id", "left")
    coordinates = [F.col(f"{w}_{h}").alias(f"read_{w}_{h}") for h in "MP" for w in ("start", "end")]
    strand = lambda k: unitigs.select((2 * F.col("index") + k).alias("node"), F.col("length").alias("read_length"), "support", "read_chr", (F.col("read_strand") * (1 - 2 * k)).alias("read_strand"), "variant", *coordinates)
    unitigs = written(unitigs, "graph-unitigs")
    nodes = strand(0).unionByName(strand(1))
    edges = written(segment_edges(scan_gfa_l(split), segments), "graph-edges")
    if final is not None:
        held = placements.join(segments.select("seg_id", "index"), "seg_id")
        alone = held.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("seg_id")
        turned = (F.col("orient") == "-").cast("long")
        read_nodes = written(held.join(alone, "seg_id").select("read_id", (2 * F.col("index") + turned).alias("node")), "graph-reads")
        # reads inside longer segments have no node, and aren't to be made anew
        inside = held.join(alone, "seg_id", "left_anti").select("read_id").distinct()
        pairs = final.join(inside.withColumnRenamed("read_id", "read_a"), "read_a", "left_anti").join(inside.withColumnRenamed("read_id", "read_b"), "read_b", "left_anti")
        lengths = reads.select("read_id", (F.col("read_end") - F.col("read_start")).alias("read_length"))
        new, edges = rescue(edges, nodes, pairs, read_nodes, lengths)
        own = lambda w, h: F.when(F.col("variant") == h, F.col(f"read_{w}")).alias(f"read_{w}_{h}")
        facts = written(new.join(reads.drop("read_length") if "read_length" in reads.columns else reads, "read_id"), "graph-new")
        made = lambda k: facts.select((F.col("node") + k).alias("node"), "read_length", F.lit(None).cast("double").alias("support"), "read_chr", (F.col("read_strand") * (1 - 2 * k)).alias("read_strand"), "variant", *(own(w, h) for h in "MP" for w in ("start", "end")))
        nodes, edges = nodes.unionByName(made(0)).unionByName(made(1)), written(edges, "graph-edges")
    return nodes, edges.join(create_gt(edges, nodes), ["src", "dst"])


# -- lines out -------------------------------------------------------------------------------------------------------


def fasta_lines(contigs: DataFrame, id_col: str = "contig_id", seq_col: str = "seq", description: Column | None = None) -> DataFrame:
    """value: header and sequence, two lines a record."""
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("") if description is None else F.concat(F.lit(" "), description))
    return contigs.select(F.concat(head, F.lit("\n"), F.col(seq_col)).alias("value"))


def segment_name(index: Column) -> Column:
    """Name of the segment of a pair: six digits at least, and all of those of longer numbers (``lpad`` by itself cuts them off)."""
    digits = index.cast("string")
    return F.concat(F.lit("utg"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def gfa_s_lines(nodes: DataFrame, depth: int = 100, name: Callable[[Column], Column] = segment_name) -> DataFrame:
    """S lines of forward nodes: node, value. nodes: node, read_length, support, and seq if there are sequences."""
    seq = F.col("seq") if "seq" in nodes.columns else F.lit("*")
    support = F.greatest(F.lit(1).cast("long"), F.floor(F.coalesce("support", F.lit(0.0)) * depth + 1e-9))
    line = F.concat_ws("\t", F.lit("S"), name(F.expr("node div 2")), seq, F.concat(F.lit("LN:i:"), "read_length"), F.concat(F.lit("rd:i:"), support.cast("string")))
    return nodes.where("node % 2 = 0").select("node", line.alias("value"))


def gfa_l_lines(edges: DataFrame, name: Callable[[Column], Column] = segment_name) -> DataFrame:
    """L lines, one for each pair of mirrors: src, dst, value."""
    from pairstrand.operators.graph import canonical

    of = lambda c: name(F.expr(f"{c} div 2"))
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    line = F.concat_ws("\t", F.lit("L"), of("src"), sign("src"), of("dst"), sign("dst"), F.concat(F.col("overlap_length").cast("string"), F.lit("M")))
    return canonical(edges).dropDuplicates(["src", "dst"]).select("src", "dst", line.alias("value"))


def write_gfa(nodes: DataFrame, edges: DataFrame, path: str, depth: int = 100) -> None:
    """A folder of GFA parts, which in the order of their names hold the header, the segments and the links."""
    head = nodes.sparkSession.createDataFrame([(0, 0, 0, "H\tVN:Z:1.0")], "kind int, a long, b long, value string")
    segments = gfa_s_lines(nodes, depth).select(F.lit(1), "node", F.lit(0), "value")
    links = gfa_l_lines(edges).select(F.lit(2), "src", "dst", "value")
    lines = written(head.union(segments).union(links), "gfa-lines")  # sorting looks at them twice
    lines.orderBy("kind", "a", "b").select("value").write.text(path)
    forget(lines)


def gfa_to_fasta(split: DataFrame) -> DataFrame:
    """value: the segments of a GFA file that have sequences, as FASTA."""
    return fasta_lines(scan_gfa_s(split).where(~F.col("seq").startswith("*")), "seg_id")


def write_fasta(contigs: DataFrame, path: str, compression: str | None = None, **names: str) -> None:
    writer = fasta_lines(contigs, **names).write
    (writer.option("compression", compression) if compression else writer).text(path)


def write_walks(walks: DataFrame, contigs: DataFrame, path: str, compression: str | None = None) -> None:
    """Walks and contigs by haplotype: Parquet, and FASTA under hap1 (paternal) and hap2 (maternal), which is made from the contigs' Parquet."""
    walks.write.partitionBy("hap").parquet(f"{path}/walks")
    contigs.write.option("compression", "zstd").partitionBy("hap").parquet(f"{path}/contigs")
    kept = contigs.sparkSession.read.schema(contigs.schema).parquet(f"{path}/contigs")
    for hap, name in (("p", "hap1"), ("m", "hap2")):
        write_fasta(kept.where(F.col("hap") == hap), f"{path}/{name}.fasta", compression)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as Parquet, by graph_id if there is one."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        writer = table.write.partitionBy("graph_id") if "graph_id" in table.columns else table.write
        writer.parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def ml_graph(nodes: DataFrame, edges: DataFrame, node_columns: list[str], edge_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables for training: missing node attributes become 0, edge attributes that aren't there are left out."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in nodes.columns else F.lit(0.0)
    return nodes.select("node", *(value(c).alias(c) for c in node_columns)), edges.select("src", "dst", *(c for c in edge_columns if c in edges.columns))


def chromosome_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per chromosome, what its training graph holds: chr, gt_bin, n, percent (of the chromosome's edges).

    edges: src, dst, gt_bin. An edge between chromosomes is in no graph.
    """
    counts = ml_graph_by_chr(nodes, edges.select("src", "dst", "gt_bin")).groupBy("chr", "gt_bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("chr", "gt_bin", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("chr")), 6).alias("percent"))


def graph_names(counts: DataFrame) -> DataFrame:
    """chr, name: names of numbered graphs. counts: chr, amount, first (the first number)."""
    rows = counts.where("amount > 0").select("chr", F.explode(F.expr("sequence(first, first + amount - 1)")).alias("k"))
    return rows.select("chr", F.concat_ws("_", F.translate("chr", ".", "_"), F.col("k").cast("string")).alias("name"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows (run, epoch, ...) to a run log."""
    metrics.write.mode("append").partitionBy("run").parquet(path)


def checkpoints(metrics: DataFrame, every: int = 10) -> DataFrame:
    """run, epoch, f1, best: the epochs whose models are kept, those better than all before (best) and every tenth."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.col("f1") > F.coalesce(F.max("f1").over(before), F.lit(float("-inf")))
    return metrics.select("run", "epoch", "f1", best.alias("best")).where(F.col("best") | (F.col("epoch") % every == 0))


def ml_graph_by_chr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges within one (normalised) chromosome, with it: chr first, for ``write.partitionBy('chr')``."""
    from pairstrand.functions.strings import normalise_chr

    of = lambda end: nodes.select(F.col("node").alias(end), normalise_chr(F.col("read_chr")).alias(f"{end}_chr"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_chr = dst_chr")
    return both.select(F.col("src_chr").alias("chr"), *edges.columns)
