"""Queries that put several operators together, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairstrand.operators import explore, labels, metrics, refine, sampling, simplify
from pairstrand.plans.registry import ORACLES, QUERIES, query
from pairstrand.plans.structure_queries import CHAIN_TABLE_SQL, CLASS_SQL, RECURSIVE, TRIO_SQL, W, chain_blocks, tables
from pairstrand.plans.walk_queries import A_SQL, DNA_SQL, UNITIG_SQL, WALK_SQL, _dna, _headers, _placements, _six_digits, _walks
from pairstrand.sources import fixture as fx
from pairstrand.sources import formats
from pairstrand.sources.shared import new_folder

#: Reads are unitigs of their own; every third has paternal coordinates only, the others maternal ones only.
ONE_READ_SQL = CLASS_SQL.replace('CASE WHEN rid % 3 <> 1 THEN s + 1000 END AS "read_start_P", CASE WHEN rid % 3 <> 1 THEN s + len + 1000 END AS "read_end_P"', 'CASE WHEN rid % 3 = 0 THEN s END AS "read_start_P", CASE WHEN rid % 3 = 0 THEN s + len END AS "read_end_P"')


@query("build_graph", W + ONE_READ_SQL + " SELECT DISTINCT gt.*, e.overlap_length, e.prefix_length FROM gt JOIN edges e ON e.src = gt.src AND e.dst = gt.dst")
def build_graph(spark, d):
    """A GFA file of the fixture's graph, written, and read again with its reads' headers."""
    r, n, e = tables(spark, d)
    path = new_folder(spark, "gfa")
    placed = r.select(F.concat_ws("\t", F.lit("A"), formats.segment_name(F.col("rid")), F.lit("0"), F.lit("+"), F.concat(F.lit("read"), "rid"), F.lit("0"), F.col("len").cast("string"), F.lit("id:i:0"), F.lit("HG:A:a")).alias("value"))
    formats.write_gfa(n, e, f"{path}/graph")
    placed.write.text(f"{path}/reads")
    lines = formats.fields(formats.numbered_lines(spark, f"{path}/graph")).unionByName(formats.fields(formats.numbered_lines(spark, f"{path}/reads")))
    variant = F.when(F.col("rid") % 3 == 0, "P").otherwise("M")
    headers = formats.parse_headers(_headers(spark, d)).select(F.concat(F.lit("read"), "rid").alias("read_id"), "read_strand", "read_chr", variant.alias("variant"), "read_start", "read_end")
    return formats.build_graph(lines, headers, 100)[1]


@query("evaluate_synthetic", "SELECT * FROM (" + ") JOIN (".join(f"{ORACLES[x]}) USING (hap" if k else ORACLES[x] for k, x in enumerate(["edge_correctness", "phasing_errors", "kmer_error", "n50"])) + ")")
def evaluate_synthetic(spark, d):
    w, n, e = _walks(spark, d)
    classified = labels.classify_edges(metrics.walk_edges(w).select("src", "dst").distinct(), n).select("src", "dst", "class")
    return metrics.evaluate(w, n, e, classified, "yak_m")


_LIFTED = {f"{e}_{h}": f"(SELECT q_start + x.\"{e}_{h}\" - t_start FROM chain c WHERE c.chr = x.read_chr AND x.\"{e}_{h}\" >= t_start AND x.\"{e}_{h}\" < t_end)" for e in ("start", "end") for h in "MP"}


@query(
    "complete_unitigs",
    W + UNITIG_SQL + ", " + CHAIN_TABLE_SQL + """,
    rolled AS (SELECT rows.seg_id, any_value(chrs.chr) AS read_chr, min(s) FILTER (variant = 'M') AS "start_M", max(e) FILTER (variant = 'M') AS "end_M", min(s) FILTER (variant = 'P') AS "start_P", max(e) FILTER (variant = 'P') AS "end_P",
      count(*) FILTER (variant = 'M') AS nm, count(*) FILTER (variant = 'P') AS np FROM rows JOIN chrs ON chrs.seg_id = rows.seg_id GROUP BY rows.seg_id),
    lifted AS (SELECT *, """ + ", ".join(f"{sql} AS l_{name}" for name, sql in _LIFTED.items()) + """ FROM rolled x),
    judged AS (SELECT *, coalesce("end_M" > "start_M" AND "end_P" > "start_P" AND abs(("end_M" - "start_M") - ("end_P" - "start_P"))::DOUBLE / greatest("end_M" - "start_M", "end_P" - "start_P") > 0.1::DOUBLE, FALSE) AS apart FROM lifted)
    SELECT seg_id, """
    + ", ".join(
        f"coalesce(CASE WHEN n{h.lower()} = 0 OR (apart AND n{h.lower()} > 0 AND n{o.lower()} > n{h.lower()} AND l_start_{o} IS NOT NULL AND l_end_{o} IS NOT NULL) THEN l_{e}_{o} ELSE \"{e}_{h}\" END, -1) AS \"{e}_{h}\""
        for h, o in ("MP", "PM")
        for e in ("start", "end")
    )
    + " FROM judged",
)
def complete_unitigs(spark, d):
    r = fx.reads(spark, d)
    variant = F.when(F.col("rid") % 3 == 0, "P").otherwise("M")
    reads = r.select(F.concat(F.lit("read"), "rid").alias("read_id"), F.col("strand").alias("read_strand"), F.col("chr").alias("read_chr"), variant.alias("variant"), F.col("s").alias("read_start"), (F.col("s") + F.col("len")).alias("read_end"))
    rolled = labels.unitig_rollup(formats.scan_gfa_a(formats.fields(_placements(spark, d))), reads)
    chain = chain_blocks(r)
    return labels.complete_unitigs(rolled, chain, chain).fillna(-1)


@query("scan_fasta", W + DNA_SQL + " SELECT doc_id::VARCHAR AS read_id, doc_id::VARCHAR AS description, seq FROM dna")
def scan_fasta(spark, d):
    path = new_folder(spark, "fasta")
    formats.write_fasta(_dna(spark, d), path, id_col="doc_id")
    return formats.scan_fasta(spark, path)


@query("scan_fastq", W + DNA_SQL + " SELECT doc_id::VARCHAR AS read_id, 'read=' || doc_id || ',x' AS description, seq FROM dna")
def scan_fastq(spark, d):
    path = new_folder(spark, "fastq")
    record = F.concat_ws("\n", F.concat(F.lit("@read="), "doc_id", F.lit(",x")), "seq", F.lit("+"), F.translate("seq", "ACGTNRYK", "IIIIIIII"))
    _dna(spark, d).select(record.alias("value")).write.text(path)
    return formats.scan_fastq(spark, path)


@query("scan_trio", W + fx.NODES_SQL + " SELECT node, trio_label, strong_pat, strong_mat FROM nodes WHERE node % 2 = 0")
def scan_trio(spark, d):
    path = new_folder(spark, "trio")
    n = fx.nodes(fx.reads(spark, d)).where("node % 2 = 0")
    n.select(F.concat_ws("\t", F.concat(F.lit("utg"), F.lpad(F.col("node").cast("string"), 12, "0")), "trio_label", F.col("strong_pat").cast("string"), F.col("strong_mat").cast("string")).alias("value")).write.text(path)
    return formats.scan_trio(spark, path)


GFA_SEQ_SQL = W + DNA_SQL + " SELECT '>utg' || lpad(doc_id::VARCHAR, 6, '0') || chr(10) || seq AS value FROM dna WHERE seq <> ''"


@query("sink_gfa2fa", GFA_SEQ_SQL)
def sink_gfa2fa(spark, d):
    """Sequences as segments of a GFA file, and these as FASTA."""
    segments = _dna(spark, d).where("seq <> ''").select((2 * F.col("doc_id")).alias("node"), F.length("seq").cast("long").alias("read_length"), F.lit(None).cast("double").alias("support"), "seq")
    lines = formats.gfa_s_lines(segments, name=_six_digits).select(F.col("node").alias("line_no"), "value")
    return formats.gfa_to_fasta(formats.fields(lines))


@query("graph_numbering", "SELECT event_type AS chr, replace(event_type, '.', '_') || '_' || k AS name FROM (SELECT event_type, count(*) % 7 AS amount, length(event_type) AS first FROM events GROUP BY 1), LATERAL (SELECT unnest(range(first, first + amount)) AS k)")
def graph_numbering(spark, d):
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("chr")).agg((F.count(F.lit(1)) % 7).alias("amount"))
    return formats.graph_names(counts.withColumn("first", F.length("chr").cast("long")))


_LOG_SQL = "m AS (SELECT event_type AS run, user_id AS epoch, round(avg(value) / 1000, 6) AS f1 FROM events GROUP BY ALL)"


@query("sink_metrics", W + _LOG_SQL + ", b AS (SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS best FROM m) SELECT run, epoch, f1, best FROM b WHERE best OR epoch % 10 = 0")
def sink_metrics(spark, d):
    """A log of runs that is written in two parts, and the epochs whose models are kept."""
    log = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("epoch")).agg(F.round(F.avg("value") / 1000, 6).alias("f1"))
    path = new_folder(spark, "metrics")
    for part in (log.where("epoch % 2 = 0"), log.where("epoch % 2 = 1")):
        formats.append_metrics(part, path)
    return formats.checkpoints(spark.read.schema(log.schema).parquet(path))


@query("shuffle", W + fx.EDGES_SQL + " SELECT src, dst, row_number() OVER (ORDER BY md5(src || '-' || dst)) - 1 AS place FROM (SELECT DISTINCT src, dst FROM edges)")
def shuffle(spark, d):
    _, _, e = tables(spark, d)
    return sampling.shuffled(e.select("src", "dst").distinct(), F.md5(F.concat_ws("-", "src", "dst")))


@query(
    "chromosome_labels",
    W + CLASS_SQL + """, within AS (SELECT CASE WHEN a.read_chr LIKE 'chr%' THEN a.read_chr ELSE 'chr' || a.read_chr END AS chr, gt_bin FROM gt JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.read_chr = b.read_chr)
    SELECT chr, gt_bin, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY chr), 6) AS percent FROM within GROUP BY chr, gt_bin""",
)
def chromosome_labels(spark, d):
    _, n, e = tables(spark, d)
    return formats.chromosome_labels(n, labels.create_gt(e, n))


#: A number between 0 and 1 from 52 bits of a digest.
@query("sample_weighted", W + fx.EDGES_SQL + ", u AS (SELECT src, dst, score, (('0x' || substr(md5(src || '-' || dst), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM scored WHERE score > 0) SELECT src, dst, score FROM u ORDER BY -ln(u) / score, src, dst LIMIT 100")
def sample_weighted(spark, d):
    digits = F.conv(F.substring(F.md5(F.concat_ws("-", "src", "dst")), 1, 13), 16, 10).cast("double")
    return sampling.weighted(fx.scored(fx.edges(fx.reads(spark, d))), 100, "score", u=(digits + 0.5) / float(1 << 52)).select("src", "dst", "score")


@query("graph_round_trip", W + fx.EDGES_SQL + " SELECT DISTINCT src, dst, overlap_length, prefix_length FROM edges")
def graph_round_trip(spark, d):
    """Edges of a graph that is written and read again."""
    _, n, e = tables(spark, d)
    path = new_folder(spark, "graph")
    formats.write_graph(n, e.distinct(), path)
    return formats.read_graph(spark, path)[1]


@query(
    "sink_walks",
    ORACLES["walk_to_seq"].replace("\n    SELECT hap, walk_id, length(string_agg", ", spelled AS (SELECT hap, walk_id, length(string_agg", 1)
    + """), every AS (SELECT hap, walk_id, 'contig' AS kind, length AS n, md5(seq) AS digest FROM spelled
    UNION ALL SELECT hap, walk_id, 'fasta', length, md5('>' || walk_id || chr(10) || seq) FROM spelled
    UNION ALL SELECT hap, walk_id, 'walk', count(*), md5(string_agg(node::VARCHAR, ' ' ORDER BY pos)) FROM walks GROUP BY hap, walk_id)
    SELECT hap, walk_id, kind, n, digest FROM every""",
)
def sink_walks(spark, d):
    """Walks, contigs and FASTA by haplotype, written and read again: sizes and digests of each."""
    w, _, _ = _walks(spark, d)
    contigs = QUERIES["walk_to_seq"](spark, d).withColumn("contig_id", F.col("walk_id"))
    path = new_folder(spark, "walks")
    formats.write_walks(w, contigs, path, "gzip")
    c = spark.read.parquet(f"{path}/contigs")
    nodes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"].cast("string")), " ")
    walks = spark.read.parquet(f"{path}/walks").groupBy("hap", "walk_id").agg(F.count(F.lit(1)).alias("n"), F.md5(nodes).alias("digest"))
    reads = [formats.scan_fasta(spark, f"{path}/{name}.fasta").select(F.lit(hap).alias("hap"), F.col("description").alias("walk_id"), "seq") for hap, name in (("p", "hap1"), ("m", "hap2"))]
    fasta = reads[0].union(reads[1]).withColumns({"n": F.length("seq"), "digest": F.md5(F.concat(F.lit(">"), "walk_id", F.lit("\n"), "seq"))})
    named = lambda df, kind: df.select("hap", F.col("walk_id").cast("long").alias("walk_id"), F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"), "digest")
    return named(c.withColumns({"n": F.length("seq"), "digest": F.md5("seq")}), "contig").union(named(fasta, "fasta")).union(named(walks, "walk"))


@query("scan_chain", W + fx.R_SQL + ", " + CHAIN_TABLE_SQL + " SELECT chr, t_start, t_end, chr AS q_chr, q_start, '+' AS q_strand, 1000000000000 AS q_size FROM chain")
def scan_chain(spark, d):
    """The blocks of ``liftover`` as a chain file, which is written and read again."""
    blocks = chain_blocks(fx.reads(spark, d))
    along = Window.partitionBy("chr").orderBy("t_start")
    nxt = lambda c: F.lead(c).over(along)
    size = F.col("t_end") - F.col("t_start")
    gaps = [(nxt("t_start") - F.col("t_end")).cast("string"), (nxt("q_start") - F.col("q_start") - size).cast("string")]
    rows = blocks.select("chr", F.col("t_start").alias("at"), F.concat_ws("\t", size.cast("string"), *gaps).alias("value"))
    first = blocks.groupBy("chr").agg(F.min("t_start").alias("t"), F.min("q_start").alias("q"))
    head = F.concat_ws(" ", F.lit("chain 9"), "chr", F.lit("1000000000000 +"), F.col("t").cast("string"), F.lit("0"), "chr", F.lit("1000000000000 +"), F.col("q").cast("string"), F.lit("0 1"))
    path = new_folder(spark, "chain")
    first.select("chr", F.lit(-1).cast("long").alias("at"), head.alias("value")).union(rows).orderBy("chr", "at").select("value").write.text(path)
    return formats.scan_chain(formats.numbered_lines(spark, path))


@query("scan_yak_eval", "SELECT CASE WHEN event_id % 2 = 0 THEN 'W' ELSE 'H' END AS tag, arg_max(round(value / 1000, 6), event_id) AS rate FROM events GROUP BY 1")
def scan_yak_eval(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat_ws("\t", F.when(F.col("event_id") % 2 == 0, "W").otherwise("H"), F.col("event_id").cast("string"), F.lit("10"), F.round(F.col("value") / 1000, 6).cast("string"))
    return formats.scan_yak_eval(e.select(F.col("event_id").alias("line_no"), line.alias("value")))


@query("scan_minigraph", "WITH last AS (SELECT ['NG50', 'Length', 'Rdup'][1 + event_id % 3] AS metric, arg_max(user_id, event_id)::DOUBLE AS value FROM events GROUP BY 1) SELECT metric, coalesce(value, 0) AS value FROM (VALUES ('NG50'), ('NGA50'), ('Length'), ('Rdup')) n(metric) LEFT JOIN last USING (metric)")
def scan_minigraph(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.element_at(F.array(F.lit("NG50"), F.lit("Length"), F.lit("Rdup")), (F.col("event_id") % 3 + 1).cast("int"))
    return formats.scan_assembly_report(e.select(F.col("event_id").alias("line_no"), F.concat_ws(" ", name, F.col("user_id").cast("string")).alias("value")))


@query("is_synthetic", W + fx.NODES_SQL + " SELECT count(read_chr) > count(*) // 2 AS is_synthetic FROM (SELECT * FROM nodes ORDER BY node LIMIT 10)")
def is_synthetic(spark, d):
    return spark.createDataFrame([(simplify.is_synthetic(fx.nodes(fx.reads(spark, d))),)], "is_synthetic boolean")


#: Costs of ways along the users' graph, which has no cycles: bases of the other haplotype's nodes.
_WAYS_SQL = WALK_SQL + "," + TRIO_SQL + """,
cost AS (SELECT ug.src, ug.dst, CASE WHEN yak_m = -1 THEN 20 * read_length ELSE 0 END AS w FROM ug JOIN trio ON trio.node = ug.dst JOIN nodes ON nodes.node = ug.dst)"""


@query(
    "dijkstra_refine",
    RECURSIVE + _WAYS_SQL + """, ends AS (SELECT hap, walk_id, arg_min(node, pos) AS start, arg_max(node, pos) AS stop FROM walks GROUP BY ALL),
    way AS (SELECT hap, walk_id, start AS node, stop, 0::BIGINT AS c FROM ends UNION SELECT hap, walk_id, dst, stop, c + w FROM way JOIN cost ON cost.src = way.node)
    SELECT hap, walk_id, min(c)::BIGINT AS cost FROM way WHERE node = stop GROUP BY hap, walk_id""",
)
def dijkstra_refine(spark, d):
    """What the lightest way between each walk's ends costs."""
    w, n, e = _walks(spark, d)
    return refine.reroute(w, e, n, "yak_m").select("hap", "walk_id", "cost")


@query(
    "double_dfs",
    RECURSIVE + _WAYS_SQL + """, rated AS (SELECT src, dst, ((src * 31 + dst * 17) % 100)::DOUBLE / 100::DOUBLE AS score FROM ug),
    near AS (SELECT src, dst FROM (SELECT *, min(score) OVER (PARTITION BY src) AS best FROM rated) WHERE score <= best + 0.1::DOUBLE),
    ends AS (SELECT hap, walk_id, arg_min(node, pos) AS start, arg_max(node, pos) AS stop FROM walks GROUP BY ALL),
    way AS (SELECT hap, walk_id, start AS node, stop, 0::BIGINT AS c FROM ends UNION SELECT hap, walk_id, cost.dst, stop, c + w FROM way JOIN near ON near.src = way.node JOIN cost ON cost.src = near.src AND cost.dst = near.dst)
    SELECT hap, walk_id, min(c)::BIGINT AS cost FROM way WHERE node = stop GROUP BY hap, walk_id""",
)
def double_dfs(spark, d):
    """The same by edges only that are about as good as the best ones beside them; walks that these don't join are left out."""
    w, n, e = _walks(spark, d)
    return refine.reroute(w, refine.near_best(fx.scored(e), "score"), n, "yak_m").select("hap", "walk_id", "cost")


@query(
    "bubble_fix",
    RECURSIVE + _WAYS_SQL + """, k AS (SELECT w.*, yak_m, read_length FROM walks w JOIN trio USING (node) JOIN nodes USING (node)),
    b AS (SELECT *, pos - row_number() OVER (PARTITION BY hap, walk_id ORDER BY pos) AS isle FROM k WHERE yak_m = -1),
    runs AS (SELECT hap, walk_id, min(pos) AS lo, max(pos) AS hi, sum(20 * read_length) AS now FROM b GROUP BY hap, walk_id, isle),
    ends AS (SELECT runs.*, x.node AS start, y.node AS stop FROM runs JOIN walks x ON x.hap = runs.hap AND x.walk_id = runs.walk_id AND x.pos = lo - 1 JOIN walks y ON y.hap = runs.hap AND y.walk_id = runs.walk_id AND y.pos = hi + 1),
    way AS (SELECT hap, walk_id, lo, now, start AS node, stop, 0::BIGINT AS c FROM ends UNION SELECT hap, walk_id, lo, now, dst, stop, c + w FROM way JOIN cost ON cost.src = way.node),
    less AS (SELECT hap, walk_id, lo, least(now, coalesce(min(c) FILTER (node = stop), now)) AS after, any_value(now) AS now FROM way GROUP BY hap, walk_id, lo, way.now),
    total AS (SELECT hap, walk_id, sum(CASE WHEN yak_m = -1 THEN 20 * read_length ELSE 0 END) AS wrong FROM k GROUP BY ALL)
    SELECT total.hap, total.walk_id, (any_value(wrong) - coalesce(sum(now - after), 0))::BIGINT AS wrong FROM total LEFT JOIN less ON less.hap = total.hap AND less.walk_id = total.walk_id GROUP BY total.hap, total.walk_id""",
)
def bubble_fix(spark, d):
    """Bases of the other haplotype that walks hold when their wrong runs have been replaced."""
    w, n, e = _walks(spark, d)
    fixed = refine.fix_bubbles(w, e, n, "yak_m")
    wrong = F.when(F.col("yak_m") == -1, F.col("read_length")).otherwise(F.lit(0))
    return fixed.join(n.select("node", "yak_m", "read_length"), "node").groupBy("hap", "walk_id").agg(F.sum(wrong).alias("wrong"))


@query(
    "bellman_refine",
    RECURSIVE + _WAYS_SQL + """, ends AS (SELECT hap, walk_id, arg_min(node, pos) AS start, arg_max(node, pos) AS stop, count(*) AS n FROM walks GROUP BY ALL),
    step AS (SELECT src, dst, CASE WHEN yak_m = -1 THEN 10 ELSE -1 END AS w FROM (SELECT DISTINCT src, dst FROM ug) JOIN trio ON node = dst),
    way AS (SELECT hap, walk_id, start AS node, stop, 0::BIGINT AS c FROM ends WHERE n > 2 UNION SELECT hap, walk_id, dst, stop, c + w FROM way JOIN step ON step.src = way.node),
    least AS (SELECT hap, walk_id, min(c)::BIGINT AS cost FROM way WHERE node = stop GROUP BY ALL),
    own AS (SELECT hap, walk_id, sum(CASE WHEN pos = lo THEN 0 WHEN yak_m = -1 THEN 10 ELSE -1 END)::BIGINT AS cost FROM (SELECT *, min(pos) OVER (PARTITION BY hap, walk_id) AS lo FROM walks) JOIN trio USING (node) GROUP BY ALL)
    SELECT own.hap, own.walk_id, coalesce(least.cost, own.cost) AS cost FROM own LEFT JOIN least ON least.hap = own.hap AND least.walk_id = own.walk_id""",
)
def bellman_refine(spark, d):
    """What the walks weigh that take right nodes for a gain: wrong ones 10, others -1, the first one aside."""
    w, n, e = _walks(spark, d)
    new = refine.bellman_walks(w, e, n, "yak_m").join(n.select("node", "yak_m"), "node")
    weight = F.when(F.col("pos") == 0, 0).when(F.col("yak_m") == -1, 10).otherwise(-1)
    return new.groupBy("hap", "walk_id").agg(F.sum(weight).alias("cost"))


@query(
    "choke_points",
    RECURSIVE + WALK_SQL + """, ends AS (SELECT hap, walk_id, arg_min(node, pos) AS start, arg_max(node, pos) AS stop FROM walks GROUP BY ALL),
    one AS (SELECT DISTINCT src, dst FROM ug),
    ahead AS (SELECT hap, walk_id, start AS node FROM ends UNION SELECT hap, walk_id, dst FROM ahead JOIN one ON src = node),
    around AS (SELECT hap, walk_id, start, stop, ahead.node AS v, start AS node FROM ends JOIN ahead USING (hap, walk_id) WHERE ahead.node NOT IN (start, stop)
      UNION SELECT hap, walk_id, start, stop, v, dst FROM around JOIN one ON src = node WHERE dst <> v),
    missed AS (SELECT DISTINCT hap, walk_id, v FROM around WHERE node = stop),
    back AS (SELECT hap, walk_id, stop AS node FROM ends UNION SELECT hap, walk_id, src FROM back JOIN one ON dst = node)
    SELECT ahead.hap, ahead.walk_id, ahead.node FROM ahead JOIN back USING (hap, walk_id, node) LEFT JOIN missed ON missed.hap = ahead.hap AND missed.walk_id = ahead.walk_id AND v = ahead.node
    WHERE v IS NULL""",
)
def choke_points(spark, d):
    """Nodes that every way between a walk's ends passes."""
    w, _, e = _walks(spark, d)
    ends = w.groupBy("hap", "walk_id").agg(F.min_by("node", "pos").alias("start"), F.max_by("node", "pos").alias("end"))
    return refine.choke_points(e, ends, ["hap", "walk_id"]).select("hap", "walk_id", "node")


@query("fix_ends")
def fix_ends(spark, d):
    """Walks without the wrong nodes at their ends, grown anew along the best edges."""
    w, n, e = _walks(spark, d)
    return refine.extend_ends(w, fx.scored(e), n, {"p": "yak_p", "m": "yak_m"})


@query("explore_improve")
def explore_improve(spark, d):
    """Walks with the detours that lower the bases of the other haplotype."""
    w, n, e = _walks(spark, d)
    return explore.explored(w, fx.scored(e), n, {"p": "yak_p", "m": "yak_m"})


@query(
    "infer_unitig_coords",
    W + A_SQL + """, rows AS (SELECT a.seg_id, a.line_no, a."offset" AS o, a.read_id, CASE WHEN r.rid % 3 = 0 THEN 'P' ELSE 'M' END AS variant, r.len, CASE WHEN r.rid % 4 <> 1 THEN r.s END AS s FROM a JOIN r ON 'read' || r.rid = a.read_id),
    summed AS (SELECT *, coalesce(sum(len - least(1500, len // 10)) OVER (PARTITION BY seg_id, variant ORDER BY o, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rows),
    near AS (SELECT *, last_value(s - k IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, first_value(s - k IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM summed WINDOW w AS (PARTITION BY seg_id, variant ORDER BY o, line_no)),
    placed AS (SELECT seg_id, variant, len, coalesce(s, coalesce(lo, hi) + k) AS s FROM near)
    SELECT seg_id, coalesce(min(s) FILTER (variant = 'M'), -1)::BIGINT AS "start_M", coalesce(max(s + len) FILTER (variant = 'M'), -1)::BIGINT AS "end_M",
      coalesce(min(s) FILTER (variant = 'P'), -1)::BIGINT AS "start_P", coalesce(max(s + len) FILTER (variant = 'P'), -1)::BIGINT AS "end_P" FROM placed GROUP BY seg_id""",
)
def infer_unitig_coords(spark, d):
    """Unitigs' spans when every fourth read has no coordinates of its own."""
    placed = formats.scan_gfa_a(formats.fields(_placements(spark, d)))
    start = F.when(F.col("rid") % 4 != 1, F.col("s"))
    reads = fx.reads(spark, d).select(F.concat(F.lit("read"), "rid").alias("read_id"), F.when(F.col("rid") % 3 == 0, "P").otherwise("M").alias("variant"), F.col("len").alias("read_length"), start.alias("read_start"), (start + F.col("len")).alias("read_end"))
    return labels.unitig_spans(labels.infer_read_coords(placed, reads)).fillna(-1, ["start_M", "end_M", "start_P", "end_P"])
