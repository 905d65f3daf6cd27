"""Queries on graph structure, labels, simplification, cuts, components and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstrand.functions.predicates import is_correct_edge
from pairstrand.functions.strings import complement
from pairstrand.operators import components, cuts, graph, joins, labels, partition, sampling, simplify
from pairstrand.plans.registry import query
from pairstrand.sources import fixture as fx
from pairstrand.sources.shared import written

W = "WITH "
RECURSIVE = "WITH RECURSIVE "


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = fx.reads(spark, d)
    return r, fx.nodes(r), fx.edges(r)


#: Missing coordinates and places are shown as -1.
NO_NULLS_SQL = ", ".join(f'coalesce("{c}", -1) AS "{c}"' for c in labels.COORDINATES)


@query("nodes_fixture", W + fx.NODES_SQL + f" SELECT * REPLACE ({NO_NULLS_SQL}, coalesce(support, -1) AS support) FROM nodes")
def nodes_fixture(spark, d):
    return fx.nodes(fx.reads(spark, d)).fillna(-1, [*labels.COORDINATES, "support"])


@query("edges_fixture", W + fx.EDGES_SQL + " SELECT * FROM edges")
def edges_fixture(spark, d):
    return fx.edges(fx.reads(spark, d))


@query("complement_edge", W + fx.EDGES_SQL + " SELECT src, dst, xor(dst, 1) AS mirror_src, xor(src, 1) AS mirror_dst FROM edges")
def complement_edge(spark, d):
    e = fx.edges(fx.reads(spark, d))
    return e.select("src", "dst", complement(F.col("dst")).alias("mirror_src"), complement(F.col("src")).alias("mirror_dst"))


@query("canonical_edges", W + fx.EDGES_SQL + " SELECT src, dst FROM edges WHERE src < xor(dst, 1) OR (src = xor(dst, 1) AND dst <= xor(src, 1))")
def canonical_edges(spark, d):
    return graph.canonical(fx.edges(fx.reads(spark, d))).select("src", "dst")


@query("reverse_graph", W + fx.EDGES_SQL + " SELECT dst AS src, src AS dst FROM edges")
def reverse_graph(spark, d):
    return graph.reverse_graph(fx.edges(fx.reads(spark, d))).select("src", "dst")


@query(
    "degree",
    W + fx.EDGES_SQL + """ SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS in_deg, (SELECT count(*) FROM edges WHERE src = node) AS out_deg FROM nodes""",
)
def degree(spark, d):
    _, n, e = tables(spark, d)
    return graph.degrees(n, e)


#: Edges with some removed, so that mirrors are missing.
TORN_SQL = fx.EDGES_SQL + ", torn AS (SELECT * FROM edges WHERE (src * 3 + dst) % 7 <> 0)"


def torn(e: DataFrame) -> DataFrame:
    return e.where((F.col("src") * 3 + F.col("dst")) % 7 != 0)


@query("mirror_anti", W + TORN_SQL + " SELECT src, dst FROM torn t WHERE NOT EXISTS (SELECT 1 FROM torn u WHERE u.src = xor(t.dst, 1) AND u.dst = xor(t.src, 1))")
def mirror_anti(spark, d):
    return graph.mirror_anti(torn(fx.edges(fx.reads(spark, d)))).select("src", "dst")


@query("mirror_semi", W + TORN_SQL + " SELECT src, dst FROM torn t WHERE EXISTS (SELECT 1 FROM torn u WHERE u.src = xor(t.dst, 1) AND u.dst = xor(t.src, 1))")
def mirror_semi(spark, d):
    return graph.mirror_semi(torn(fx.edges(fx.reads(spark, d)))).select("src", "dst")


@query("missing_complements", W + fx.NODES_SQL + " SELECT node FROM nodes WHERE node % 5 <> 0 AND xor(node, 1) % 5 = 0")
def missing_complements(spark, d):
    n = fx.nodes(fx.reads(spark, d)).where(F.col("node") % 5 != 0)
    return graph.missing_complements(n).select("node")


@query("edge_integrity", W + fx.EDGES_SQL + " SELECT src, dst FROM edges WHERE src % 5 = 0 OR dst % 5 = 0")
def edge_integrity(spark, d):
    _, n, e = tables(spark, d)
    return graph.edge_integrity(n.where(F.col("node") % 5 != 0), e)


@query(
    "validate_graph",
    W + TORN_SQL + """, picked AS (SELECT node FROM nodes WHERE node % 5 <> 0)
    SELECT 'edges_without_nodes' AS "check", count(*) AS n FROM torn WHERE src % 5 = 0 OR dst % 5 = 0
    UNION ALL SELECT 'nodes_without_complement', count(*) FROM picked WHERE xor(node, 1) % 5 = 0
    UNION ALL SELECT 'edges_without_mirror', count(*) FROM torn t WHERE NOT EXISTS (SELECT 1 FROM torn u WHERE u.src = xor(t.dst, 1) AND u.dst = xor(t.src, 1))""",
)
def validate_graph(spark, d):
    _, n, e = tables(spark, d)
    return simplify.validate(n.where(F.col("node") % 5 != 0), torn(e))


@query("attach_endpoint_attrs", W + fx.EDGES_SQL + " SELECT src, dst, a.read_chr AS s_read_chr, a.read_length AS s_read_length, b.read_chr AS d_read_chr, b.read_length AS d_read_length FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst")
def attach_endpoint_attrs(spark, d):
    _, n, e = tables(spark, d)
    return graph.attach_endpoint_attrs(e.select("src", "dst"), n, ["read_chr", "read_length"])


@query("subgraph", W + fx.EDGES_SQL + ", picked AS (SELECT node FROM nodes WHERE read_chr = (SELECT min(read_chr) FROM nodes)) SELECT src, dst FROM edges WHERE src IN (FROM picked) AND dst IN (FROM picked)")
def subgraph(spark, d):
    _, n, e = tables(spark, d)
    first = n.agg(F.min("read_chr").alias("read_chr"))  # one row
    return graph.subgraph(e, n.join(F.broadcast(first), "read_chr")).select("src", "dst")


@query("successors", W + fx.EDGES_SQL + " SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS successors FROM edges GROUP BY src")
def successors(spark, d):
    return graph.successors(fx.edges(fx.reads(spark, d))).select("node", F.array_join(F.col("successors").cast("array<string>"), ",").alias("successors"))


# -- labels ----------------------------------------------------------------------------------------------------------

CLASS_SQL = (
    fx.EDGES_SQL
    + """,
j AS (
  SELECT e.src, e.dst, a.read_chr AS ca, b.read_chr AS cb, a.read_strand AS ta, b.read_strand AS tb,
    a."read_start_M" AS am, a."read_end_M" AS aem, b."read_start_M" AS bm, b."read_end_M" AS bem,
    a."read_start_P" AS ap, a."read_end_P" AS aep, b."read_start_P" AS bp, b."read_end_P" AS bep
  FROM edges e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst
),
ok AS (
  SELECT *,
    coalesce(NOT ((am <= bm AND aem >= bem) OR (am >= bm AND aem <= bem)) AND ((ta = 1 AND am < bm AND bm < aem) OR (ta = -1 AND bm < am AND am < bem)), FALSE) AS right_m,
    coalesce(NOT ((ap <= bp AND aep >= bep) OR (ap >= bp AND aep <= bep)) AND ((ta = 1 AND ap < bp AND bp < aep) OR (ta = -1 AND bp < ap AND ap < bep)), FALSE) AS right_p,
    (am IS NOT NULL AND bm IS NOT NULL) AS full_m, (ap IS NOT NULL AND bp IS NOT NULL) AS full_p
  FROM j
),
seen AS (
  SELECT *, CASE WHEN full_m THEN am WHEN full_p THEN ap END AS ss, CASE WHEN full_m THEN aem WHEN full_p THEN aep END AS se,
    CASE WHEN full_m THEN bm WHEN full_p THEN bp END AS ds, CASE WHEN full_m THEN bem WHEN full_p THEN bep END AS de
  FROM ok
),
cls AS (
  SELECT src, dst, ca AS read_chr,
    CASE WHEN ca <> cb THEN 'cross_chr' WHEN ta <> tb THEN 'cross_strand' WHEN right_m OR right_p THEN 'correct' WHEN ss IS NULL THEN 'unknown'
      WHEN ta = 1 AND ds >= se THEN 'forward_skip' WHEN ta = 1 AND ds <= ss THEN 'backward_skip'
      WHEN ta = -1 AND ss >= de THEN 'forward_skip' WHEN ta = -1 AND ss <= ds THEN 'backward_skip' ELSE 'unknown' END AS class
  FROM seen
),
gt AS (
  SELECT src, dst, (class = 'correct')::INT AS gt_bin, 0 AS dead_end, (class = 'cross_chr')::INT AS cross_chr, (class = 'cross_strand')::INT AS cross_strand,
    (class IN ('forward_skip', 'backward_skip'))::INT AS skip, (class = 'forward_skip')::INT AS forward_skip, (class = 'backward_skip')::INT AS backward_skip,
    (class = 'unknown')::INT AS "unknown", (class IN ('cross_chr', 'cross_strand'))::INT AS malicious,
    (class IN ('cross_chr', 'cross_strand', 'forward_skip', 'backward_skip'))::INT AS gt_no_deadend,
    (class IN ('cross_strand', 'forward_skip', 'backward_skip', 'unknown'))::INT AS single_chrom_bad,
    (CASE class WHEN 'cross_strand' THEN 10.0 WHEN 'unknown' THEN 0.1 ELSE 1.0 END)::DOUBLE AS importance_weight
  FROM cls
)"""
)
TRIO_SQL = """
trio AS (
  SELECT node, CASE trio_label WHEN 'p' THEN 1 WHEN 'm' THEN -1 ELSE 0 END AS yak_p, CASE trio_label WHEN 'p' THEN -1 WHEN 'm' THEN 1 ELSE 0 END AS yak_m,
    CASE trio_label WHEN 'a' THEN 1 ELSE 0 END AS ambiguous, CASE WHEN trio_label IN ('p', 'm') THEN 'E' ELSE 'O' END AS yak_region,
    strong_pat / 1000::DOUBLE AS kmer_count_p, strong_mat / 1000::DOUBLE AS kmer_count_m
  FROM nodes
)"""


@query("is_correct_edge", W + CLASS_SQL + " SELECT src, dst, right_m, right_p FROM ok")
def correct_edges(spark, d):
    _, n, e = tables(spark, d)
    both = graph.attach_endpoint_attrs(e.select("src", "dst"), n, ["read_strand", *labels.COORDINATES])
    right = lambda h: is_correct_edge(*(F.col(f"{p}_read_{w}_{h}") for p in "sd" for w in ("start", "end")), F.col("s_read_strand"))
    return both.select("src", "dst", right("M").alias("right_m"), right("P").alias("right_p"))


@query("edge_class", W + CLASS_SQL + " SELECT * FROM cls")
def edge_class(spark, d):
    _, n, e = tables(spark, d)
    return labels.classify_edges(e, n)


@query("edge_class_summary", W + CLASS_SQL + " SELECT read_chr, class, count(*) AS n FROM cls GROUP BY ALL")
def edge_class_summary(spark, d):
    _, n, e = tables(spark, d)
    return labels.edge_class_summary(labels.classify_edges(e, n))


@query("edge_class_rollup", W + CLASS_SQL + " SELECT read_chr, class, count(*) AS n FROM cls GROUP BY ROLLUP (read_chr, class)")
def edge_class_rollup(spark, d):
    _, n, e = tables(spark, d)
    return labels.classify_edges(e, n).rollup("read_chr", "class").agg(F.count(F.lit(1)).alias("n"))


@query("create_gt", W + CLASS_SQL + " SELECT * FROM gt")
def create_gt(spark, d):
    _, n, e = tables(spark, d)
    return labels.create_gt(e, n)


@query("label_distribution", W + CLASS_SQL + " SELECT importance_weight, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM gt), 6) AS percent FROM gt GROUP BY 1")
def label_distribution(spark, d):
    _, n, e = tables(spark, d)
    return labels.label_distribution(labels.create_gt(e, n), "importance_weight")


@query("gt_soft", W + CLASS_SQL + "," + TRIO_SQL + " SELECT src, dst, CASE WHEN gt_bin = 0 AND yak_region = 'O' AND malicious = 0 THEN 0.7::DOUBLE ELSE gt_bin::DOUBLE END AS gt_bin_soft FROM gt JOIN trio ON node = dst")
def gt_soft(spark, d):
    _, n, e = tables(spark, d)
    return labels.gt_soft(labels.create_gt(e, n), labels.trio_labels(n))


@query("gt_no_hap", W + CLASS_SQL + " SELECT src, dst, (right_m AND (src // 2) % 2 = (dst // 2) % 2)::INT AS gt FROM ok")
def gt_no_hap(spark, d):
    _, n, e = tables(spark, d)
    return labels.gt_no_hap(e, n.withColumn("variant", F.expr("(node div 2) % 2")))


@query("trio_labels", W + fx.NODES_SQL + "," + TRIO_SQL + " SELECT * FROM trio")
def trio_labels(spark, d):
    return labels.trio_labels(fx.nodes(fx.reads(spark, d)))


@query(
    "node_outcomes",
    W + CLASS_SQL + """, best AS (SELECT node, max(gt_bin) AS b FROM nodes LEFT JOIN gt ON src = node GROUP BY node)
    SELECT CASE WHEN b IS NULL THEN 'no_out_edge' WHEN b = 0 THEN 'only_wrong' ELSE 'some_correct' END AS outcome, count(*) AS n FROM best GROUP BY 1""",
)
def node_outcomes(spark, d):
    _, n, e = tables(spark, d)
    return labels.node_outcomes(labels.create_gt(e, n), n)


#: The traps of an acyclic graph: an edge is one iff no way from its end leads by correct edges to a node without out-edges.
TRAP_SQL = (
    fx.CLEAN_SQL
    + """,
marked AS (SELECT src, dst, CASE WHEN (src * 7 + dst * 3) % 5 < 2 THEN 0 ELSE 1 END AS gt_bin FROM clean),
ends AS (SELECT DISTINCT dst AS node FROM marked WHERE dst NOT IN (SELECT src FROM marked)),
alive AS (SELECT node FROM ends UNION SELECT m.src FROM marked m JOIN alive ON m.dst = alive.node WHERE m.gt_bin = 1)"""
)


@query("trap_edges", RECURSIVE + TRAP_SQL + " SELECT src, dst, (dst NOT IN (SELECT node FROM alive))::INT AS trap FROM marked")
def trap_edges(spark, d):
    e = fx.clean_edges(fx.reads(spark, d))
    marked = e.select("src", "dst", F.when((F.col("src") * 7 + F.col("dst") * 3) % 5 < 2, 0).otherwise(1).alias("gt_bin"))
    return labels.trap_edges(marked)


# -- simplification --------------------------------------------------------------------------------------------------

SELF_SQL = fx.EDGES_SQL + ", loops AS (SELECT src, dst FROM edges UNION ALL SELECT node, node FROM nodes WHERE node % 9 = 0 UNION ALL SELECT node, xor(node, 1) FROM nodes WHERE node % 10 = 0)"
TRANSITIVE_SQL = (
    fx.CLEAN_SQL
    + """,
ways AS (
  SELECT DISTINCT c.src, c.dst FROM clean a JOIN clean b ON a.dst = b.src JOIN clean c ON c.src = a.src AND c.dst = b.dst
  WHERE (c.prefix_length * (1 - 0.12::DOUBLE) <= a.prefix_length + b.prefix_length AND a.prefix_length + b.prefix_length <= c.prefix_length * (1 + 0.12::DOUBLE))
     OR ((a.prefix_length + b.prefix_length) * (1 - 0.12::DOUBLE) <= c.prefix_length AND c.prefix_length <= (a.prefix_length + b.prefix_length) * (1 + 0.12::DOUBLE))
),
theta AS (SELECT src, dst FROM ways w WHERE EXISTS (SELECT 1 FROM ways v WHERE v.src = xor(w.dst, 1) AND v.dst = xor(w.src, 1))),
reduced AS (SELECT * FROM clean c WHERE NOT EXISTS (SELECT 1 FROM theta t WHERE t.src = c.src AND t.dst = c.dst))"""
)
CHAIN_SQL = (
    TRANSITIVE_SQL
    + """,
lin AS (
  SELECT src, dst, overlap_length FROM reduced WHERE src IN (SELECT src FROM reduced GROUP BY src HAVING count(*) = 1)
    AND dst IN (SELECT dst FROM reduced GROUP BY dst HAVING count(*) = 1) AND dst <> xor(src, 1)
),
chain AS (
  SELECT src AS head, src AS node, 0::BIGINT AS pos, 0::BIGINT AS overlap FROM lin WHERE src NOT IN (SELECT dst FROM lin)
  UNION ALL SELECT head, dst, pos + 1, overlap_length FROM chain JOIN lin ON lin.src = chain.node
),
twins AS (SELECT DISTINCT a.head FROM chain a JOIN chain b ON b.node = xor(a.node, 1) AND b.head = a.head),
sized AS (SELECT head, count(*) AS n, arg_max(node, pos) AS tail FROM chain GROUP BY head),
kept AS (SELECT head, n FROM sized WHERE head < xor(tail, 1) AND head NOT IN (FROM twins))"""
)


@query("drop_self_compl", W + SELF_SQL + " SELECT * FROM loops WHERE src <> dst AND src <> xor(dst, 1)")
def drop_self_compl(spark, d):
    _, n, e = tables(spark, d)
    more = n.where("node % 9 = 0").select("node", "node").union(n.where("node % 10 = 0").select("node", complement(F.col("node"))))
    return simplify.drop_self_compl(e.select("src", "dst").union(more))


@query("triangle_theta", W + TRANSITIVE_SQL + " SELECT * FROM theta")
def triangle_theta(spark, d):
    return simplify.triangle_theta(fx.clean_edges(fx.reads(spark, d)))


@query("transitive_reduction", W + TRANSITIVE_SQL + " SELECT * FROM reduced")
def transitive_reduction(spark, d):
    return simplify.transitive_reduction(fx.clean_edges(fx.reads(spark, d)))


def _chains(spark, d):
    r = fx.reads(spark, d)
    reduced = simplify.written(simplify.transitive_reduction(fx.clean_edges(r)), "query-reduced")
    return r, reduced, simplify.written(simplify.chain_pairs(simplify.chains(simplify.drop_self_compl(reduced))), "query-chains")


@query("condense_chains", RECURSIVE + CHAIN_SQL + " SELECT c.head, c.node, c.pos FROM chain c JOIN kept k ON k.head = c.head")
def condense_chains(spark, d):
    return _chains(spark, d)[2].select("head", "node", "pos")


@query(
    "chain_rollup",
    RECURSIVE + CHAIN_SQL + """,
    modes AS (
      SELECT head, arg_min(v, struct_pack(a := -c, b := v)) AS read_chr FROM (SELECT k.head, read_chr AS v, count(*) AS c FROM chain JOIN kept k USING (head) JOIN nodes USING (node) GROUP BY ALL) GROUP BY head
    ),
    strands AS (
      SELECT head, arg_min(v, struct_pack(a := -c, b := v)) AS read_strand FROM (SELECT k.head, read_strand AS v, count(*) AS c FROM chain JOIN kept k USING (head) JOIN nodes USING (node) GROUP BY ALL) GROUP BY head
    )
    SELECT k.head, count(*) AS n, (sum(read_length) - sum(overlap))::BIGINT AS read_length,
      coalesce(round(sum(support * read_length) / sum(CASE WHEN support IS NOT NULL THEN read_length END), 6), -1) AS support,
      coalesce(min("read_start_M"), -1) AS "start_M", coalesce(max("read_end_M"), -1) AS "end_M", coalesce(min("read_start_P"), -1) AS "start_P", coalesce(max("read_end_P"), -1) AS "end_P",
      any_value(modes.read_chr) AS read_chr, any_value(strands.read_strand) AS read_strand
    FROM chain c JOIN kept k ON k.head = c.head JOIN nodes ON nodes.node = c.node JOIN modes ON modes.head = c.head JOIN strands ON strands.head = c.head GROUP BY k.head""",
)
def chain_rollup(spark, d):
    r, reduced, pairs = _chains(spark, d)
    return simplify.chain_rollup(pairs, fx.nodes(r), reduced).fillna(-1, ["support", "start_M", "end_M", "start_P", "end_P"])


#: A chain's end, the nearest node that has coordinates, and what lies between them.
_SPOT_SQL = """
spots AS (
  SELECT c.head, c.node, c.pos, s.n - 1 AS last, read_length AS len, "read_start_M" AS m, "read_start_P" AS p,
    overlap
  FROM chain c JOIN sized s ON s.head = c.head JOIN kept k ON k.head = c.head JOIN nodes ON nodes.node = c.node
),
placed AS (SELECT *, sum(len - overlap) OVER (PARTITION BY head ORDER BY pos) - len AS place_before FROM spots),
ends AS (
  SELECT o.*, 'first' AS place, (SELECT min(pos) FROM placed r WHERE r.head = o.head AND r.pos > 0 AND (r.m IS NOT NULL OR r.p IS NOT NULL)) AS at FROM placed o WHERE pos = 0
  UNION ALL SELECT o.*, 'last', (SELECT max(pos) FROM placed r WHERE r.head = o.head AND r.pos < r.last AND (r.m IS NOT NULL OR r.p IS NOT NULL)) FROM placed o WHERE pos = last
),
found AS (
  SELECT e.head, e.node, e.place, r.node AS reference, e.len, e.m AS em, e.p AS ep, r.m AS rm, r.p AS rp,
    CASE e.place WHEN 'first' THEN -(r.place_before + r.len - e.place_before) ELSE e.place_before + e.len - r.place_before END AS span
  FROM ends e JOIN placed r ON r.head = e.head AND r.pos = e.at WHERE e.m IS NULL OR e.p IS NULL
)"""


@query(
    "infer_chain_coords",
    RECURSIVE + CHAIN_SQL + "," + _SPOT_SQL + """
    SELECT head, node, place, reference, coalesce(CASE WHEN em IS NULL THEN rm + span END, -1)::BIGINT AS "start_M", coalesce(CASE WHEN em IS NULL THEN rm + span + len END, -1)::BIGINT AS "end_M",
      coalesce(CASE WHEN ep IS NULL THEN rp + span END, -1)::BIGINT AS "start_P", coalesce(CASE WHEN ep IS NULL THEN rp + span + len END, -1)::BIGINT AS "end_P" FROM found""",
)
def infer_chain_coords(spark, d):
    r, reduced, pairs = _chains(spark, d)
    return simplify.infer_chain_coords(pairs, fx.nodes(r), reduced).fillna(-1, ["start_M", "end_M", "start_P", "end_P"])


@query(
    "simplify",
    RECURSIVE + CHAIN_SQL + """,
    inner_nodes AS (SELECT c.node FROM chain c JOIN kept k ON k.head = c.head UNION SELECT xor(c.node, 1) FROM chain c JOIN kept k ON k.head = c.head),
    merged AS (SELECT (sum(read_length) - sum(overlap))::BIGINT AS read_length FROM chain c JOIN kept k ON k.head = c.head JOIN nodes ON nodes.node = c.node GROUP BY c.head)
    SELECT read_length, count(*) AS n FROM (SELECT read_length FROM nodes WHERE node NOT IN (FROM inner_nodes) UNION ALL SELECT read_length FROM merged UNION ALL SELECT read_length FROM merged) GROUP BY read_length""",
)
def simplified(spark, d):
    """Lengths of the nodes that are left, and how many have them; raises unless the graph is symmetric before and after."""
    r = fx.reads(spark, d)
    nodes, _, _ = simplify.simplify(fx.nodes(r), fx.clean_edges(r))
    return nodes.groupBy("read_length").agg(F.count(F.lit(1)).alias("n"))


#: A graph has a cycle iff a node reaches itself.
@query(
    "is_dag",
    RECURSIVE + fx.USER_SQL + """, turned AS (SELECT src, dst FROM ug UNION SELECT dst, src FROM ug WHERE src % 6 = 0),
    go AS (SELECT src AS start, dst AS node FROM ug UNION SELECT start, dst FROM go JOIN ug ON ug.src = go.node), there AS (SELECT src AS start, dst AS node FROM turned UNION SELECT start, dst FROM there JOIN turned ON turned.src = there.node)
    SELECT 'plain' AS graph, NOT EXISTS (SELECT 1 FROM go WHERE start = node) AS is_dag UNION ALL SELECT 'with_turned_edges', NOT EXISTS (SELECT 1 FROM there WHERE start = node)""",
)
def is_dag(spark, d):
    """The users' graph, and the same with some edges in both directions."""
    e = fx.user_graph(fx.reads(spark, d)).select("src", "dst")
    turned = e.union(e.where("src % 6 = 0").select("dst", "src"))
    found = [("plain", components.is_dag(e)), ("with_turned_edges", components.is_dag(turned))]
    return spark.createDataFrame(found, "graph string, is_dag boolean")


@query("deadends")
def deadends(spark, d):
    """Of the users' graph by maternal coordinates; held against a plain sweep in the tests."""
    r = fx.reads(spark, d)
    return components.deadends(fx.nodes(r), fx.user_graph(r), "read_start_M", "read_end_M")


@query(
    "condense_summary",
    RECURSIVE + CHAIN_SQL + """
    SELECT ((SELECT count(*) FROM nodes) - 2 * (SELECT sum(n - 1) FROM kept))::BIGINT AS n_nodes,
      ((SELECT count(*) FROM reduced) - 2 * (SELECT sum(n - 1) FROM kept))::BIGINT AS n_edges,
      ((SELECT sum(read_length) FROM nodes) - (SELECT sum(overlap_length) FROM reduced))::BIGINT AS length_less_overlaps""",
)
def condense_summary(spark, d):
    """Nodes and edges after condensation; lengths less overlaps are what they were before."""
    r = fx.reads(spark, d)
    reduced = simplify.written(simplify.transitive_reduction(fx.clean_edges(r)), "query-reduced")
    nodes, edges, _ = simplify.condense(fx.nodes(r), reduced)
    of_nodes = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("read_length").alias("length"))
    of_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("overlap_length").alias("overlaps"))
    return of_nodes.crossJoin(of_edges).select("n_nodes", "n_edges", (F.col("length") - F.col("overlaps")).alias("length_less_overlaps"))


@query("reindex", W + fx.NODES_SQL + ", picked AS (SELECT node FROM nodes WHERE node // 2 % 3 <> 0) SELECT node, 2 * (dense_rank() OVER (ORDER BY node // 2) - 1) + node % 2 AS new_node FROM picked")
def reindex(spark, d):
    return simplify.reindex(fx.nodes(fx.reads(spark, d)).where("(node div 2) % 3 <> 0"))


@query(
    "edge_stats",
    W + fx.EDGES_SQL + """ SELECT count(*) AS n, round(avg(overlap_length), 6) AS mean, round(stddev_pop(overlap_length), 6) AS std, min(overlap_length) AS lo, max(overlap_length) AS hi,
    quantile_cont(overlap_length, 0.25) AS p25, quantile_cont(overlap_length, 0.5) AS median, quantile_cont(overlap_length, 0.75) AS p75 FROM edges""",
)
def edge_stats(spark, d):
    return simplify.edge_stats(fx.edges(fx.reads(spark, d)), "overlap_length")


COVERAGE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS attribute, count("{c}") AS present, round(100 * count("{c}")::DOUBLE / count(*), 6) AS percent,
    CASE WHEN 100 * count("{c}")::DOUBLE / count(*) < 50 THEN 'poor' WHEN 100 * count("{c}")::DOUBLE / count(*) < 70 THEN 'fair' WHEN 100 * count("{c}")::DOUBLE / count(*) < 95 THEN 'good' ELSE 'full' END AS level FROM nodes"""
    for c in ("support", "read_start_M", "read_start_P", "read_chr")
)


@query("attr_coverage", W + fx.NODES_SQL + " " + COVERAGE_SQL)
def attr_coverage(spark, d):
    return simplify.attr_coverage(fx.nodes(fx.reads(spark, d)), ["support", "read_start_M", "read_start_P", "read_chr"])


@query(
    "support_fill",
    W + fx.CLEAN_SQL + """, near AS (SELECT src AS node, dst AS other FROM clean UNION SELECT dst, src FROM clean),
    means AS (SELECT near.node, avg(n.support) AS mean FROM near JOIN nodes n ON n.node = other GROUP BY 1)
    SELECT nodes.node, round(coalesce(support, mean, 0), 6) AS support FROM nodes LEFT JOIN means ON means.node = nodes.node""",
)
def support_fill(spark, d):
    r = fx.reads(spark, d)
    return simplify.support_fill(fx.nodes(r), fx.clean_edges(r))


# -- cuts ------------------------------------------------------------------------------------------------------------


@query("cut_threshold", W + fx.EDGES_SQL + " SELECT src, dst FROM scored WHERE score <= 0.5::DOUBLE")
def cut_threshold(spark, d):
    return cuts.cut_threshold(fx.scored(fx.edges(fx.reads(spark, d))), "score", 0.5).select("src", "dst")


REDUCED_SQL = " FROM {0} t WHERE {1} <= {2}::DOUBLE AND EXISTS (SELECT 1 FROM {0} u WHERE u.src = xor(t.dst, 1) AND u.dst = xor(t.src, 1) AND u.{1} <= {2}::DOUBLE)"


@query("reduction_drop", W + fx.EDGES_SQL + " SELECT src, dst" + REDUCED_SQL.format("scored", "score", 0.6))
def reduction_drop(spark, d):
    return cuts.reduction(fx.scored(fx.edges(fx.reads(spark, d))), "score", 0.6).select("src", "dst")


@query("reduction_restore", W + fx.EDGES_SQL + " SELECT src, dst FROM scored t WHERE score <= 0.6::DOUBLE OR EXISTS (SELECT 1 FROM scored u WHERE u.src = xor(t.dst, 1) AND u.dst = xor(t.src, 1) AND u.score <= 0.6::DOUBLE)")
def reduction_restore(spark, d):
    return cuts.reduction(fx.scored(fx.edges(fx.reads(spark, d))), "score", 0.6, restore=True).select("src", "dst")


@query("double_cut", W + fx.EDGES_SQL + ", once AS (SELECT *" + REDUCED_SQL.format("scored", "to_cut", 0.5) + ") SELECT src, dst" + REDUCED_SQL.format("once", "score", 0.9))
def double_cut(spark, d):
    return cuts.double_cut(fx.scored(fx.edges(fx.reads(spark, d)))).select("src", "dst")


@query("flip_score", W + fx.EDGES_SQL + " SELECT src, dst, round(1 - score, 6) AS score FROM scored")
def flip_score(spark, d):
    return cuts.flip_score(fx.scored(fx.edges(fx.reads(spark, d)))).select("src", "dst", F.round("score", 6).alias("score"))


@query("hap_edge_filter", W + fx.EDGES_SQL + "," + TRIO_SQL + " SELECT src, dst FROM edges JOIN trio a ON a.node = src JOIN trio b ON b.node = dst WHERE a.yak_m <> -1 AND b.yak_m <> -1")
def hap_edge_filter(spark, d):
    _, n, e = tables(spark, d)
    return cuts.hap_edge_filter(e, labels.trio_labels(n), "yak_m").select("src", "dst")


# -- components ------------------------------------------------------------------------------------------------------

KEPT_SQL = fx.USER_SQL + ", sizes AS (SELECT component, count(*) AS n, min(xor(node, 1)) AS mirror FROM comp GROUP BY 1), chosen AS (SELECT comp.* FROM comp JOIN sizes USING (component) WHERE n >= 3 AND component <= mirror)"


@query("wcc", RECURSIVE + fx.USER_SQL + " SELECT * FROM comp")
def wcc(spark, d):
    return components.wcc(fx.user_graph(fx.reads(spark, d)))


@query("find_components", RECURSIVE + KEPT_SQL + " SELECT node, component FROM chosen")
def find_components(spark, d):
    return components.find_components(fx.user_graph(fx.reads(spark, d)), 3)


@query("component_min_size", RECURSIVE + fx.USER_SQL + " SELECT component, count(*) AS n FROM comp GROUP BY 1 HAVING count(*) >= 4")
def component_min_size(spark, d):
    return components.wcc(fx.user_graph(fx.reads(spark, d))).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query(
    "component_stats",
    RECURSIVE + fx.USER_SQL + " SELECT component, count(*) AS n, sum(read_length)::BIGINT AS total_length, min(read_length) AS min_length, max(read_length) AS max_length, round(avg(read_length), 6) AS avg_length FROM comp JOIN nodes USING (node) GROUP BY 1",
)
def component_stats(spark, d):
    r = fx.reads(spark, d)
    return components.component_stats(components.wcc(fx.user_graph(r)), fx.nodes(r))


@query(
    "largest_component",
    RECURSIVE + fx.USER_SQL + ", best AS (SELECT component FROM comp JOIN nodes USING (node) GROUP BY 1 ORDER BY sum(read_length) DESC, component LIMIT 1) SELECT node, component FROM comp WHERE component IN (FROM best)",
)
def largest_component(spark, d):
    r = fx.reads(spark, d)
    return components.largest_component(components.wcc(fx.user_graph(r)), fx.nodes(r))


@query(
    "reachability",
    RECURSIVE + fx.USER_SQL + ", go AS (SELECT src AS node FROM ug WHERE src NOT IN (SELECT dst FROM ug) UNION SELECT dst FROM ug JOIN go ON ug.src = go.node) SELECT node FROM go",
)
def reachability(spark, d):
    """What all tips reach."""
    e = fx.user_graph(fx.reads(spark, d))
    return components.reachable(e, graph.tips(e))


@query("reachability_pairs", RECURSIVE + fx.USER_SQL + ", go AS (SELECT node AS start, node FROM nodes UNION SELECT start, dst FROM ug JOIN go ON ug.src = go.node) SELECT start, node FROM go")
def reachability_pairs(spark, d):
    """Per node every node that it reaches."""
    r = fx.reads(spark, d)
    return components.reachable_pairs(fx.user_graph(r), fx.nodes(r))


#: Ways from nodes to their complements exist only with edges that turn round. No shortest way has more edges than its
#: component and the mirror of that have nodes, which ends the search.
TURN_SQL = fx.USER_SQL + """,
turning AS (SELECT src, dst FROM ug UNION SELECT 2 * a, 2 * b + 1 FROM ou WHERE a % 3 = 0),
dist AS (SELECT src AS start, dst AS place, 1 AS d FROM turning UNION SELECT start, t.dst, d + 1 FROM dist JOIN turning t ON t.src = place WHERE d < (SELECT 2 * max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)))"""


@query("comp_dist", RECURSIVE + TURN_SQL + " SELECT node, coalesce((SELECT min(d) FROM dist WHERE start = node AND place = xor(node, 1)), -1)::INT AS comp_dist FROM nodes")
def comp_dist(spark, d):
    r = fx.reads(spark, d)
    e = fx.user_graph(r).select("src", "dst")
    turn = e.where("src % 2 = 0 and (src div 2) % 3 = 0").select("src", (F.col("dst") + 1).alias("dst"))
    return components.comp_dist(fx.nodes(r), e.union(turn).distinct())


@query("edge_usage")
def edge_usage(spark, d):
    """How often the shortest ways between forward nodes and their complements use each edge."""
    r = fx.reads(spark, d)
    e = fx.user_graph(r).select("src", "dst")
    turn = e.where("src % 2 = 0 and (src div 2) % 3 = 0").select("src", (F.col("dst") + 1).alias("dst"))
    return components.edge_usage(fx.nodes(r), e.union(turn).distinct())


@query("partition_cut")
def partition_cut(spark, d):
    """Balanced parts of the graph with few edges between them: per part its nodes, its halo, and the edges that leave it."""
    _, n, e = tables(spark, d)
    e = written(e.select("src", "dst"), "partition-edges")
    own = written(partition.cut_parts(n.select("node"), e, 8), "partition-own")
    halo = partition.with_halo(own, e)
    sizes = halo.groupBy("part").agg(F.count_if("own").alias("n_nodes"), F.count_if(~F.col("own")).alias("n_halo"))
    of = lambda end: own.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
    leaving = e.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("part_src <> part_dst").groupBy(F.col("part_src").alias("part")).agg(F.count(F.lit(1)).alias("n_cut"))
    return sizes.join(leaving, "part", "left").select("part", "n_nodes", "n_halo", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))


@query("partition_halo", W + fx.CLEAN_SQL + """,
  own AS (SELECT node, least(7, node // (2 * ((((SELECT max(node) FROM nodes) + 1 + 7) // 8 + 1) // 2)))::INT AS part FROM nodes),
  near AS (SELECT src AS node, dst AS other FROM clean UNION SELECT dst, src FROM clean),
  held AS (SELECT part, node FROM own UNION SELECT part, other FROM own JOIN near USING (node))
  SELECT held.part, held.node, own.part = held.part AS own FROM held JOIN own ON own.node = held.node""")
def partition_halo(spark, d):
    r = fx.reads(spark, d)
    return components.partition_with_halo(fx.nodes(r), fx.clean_edges(r), 8)


# -- neighbourhoods and other joins -------------------------------------------------------------------------------

NEAR_SQL = fx.CLEAN_SQL + ", either AS (SELECT src AS x, dst AS y FROM clean UNION SELECT dst, src FROM clean), seeds AS (SELECT DISTINCT src AS node FROM clean WHERE src NOT IN (SELECT dst FROM clean)), h1 AS (SELECT node FROM seeds UNION SELECT y FROM seeds JOIN either ON x = node), h2 AS (SELECT node FROM h1 UNION SELECT y FROM h1 JOIN either ON x = node)"


@query("one_hop", W + NEAR_SQL + " SELECT node FROM h1 UNION SELECT xor(node, 1) FROM h1")
def one_hop(spark, d):
    """Around all tips."""
    e = fx.clean_edges(fx.reads(spark, d))
    return graph.neighbourhood(e, graph.tips(e), 1)


@query("two_hop", W + NEAR_SQL + " SELECT node FROM h2 UNION SELECT xor(node, 1) FROM h2")
def two_hop(spark, d):
    e = fx.clean_edges(fx.reads(spark, d))
    return graph.neighbourhood(e, graph.tips(e), 2)


#: The same from every node, each by itself.
ALL_NEAR_SQL = fx.CLEAN_SQL + ", either AS (SELECT src AS x, dst AS y FROM clean UNION SELECT dst, src FROM clean), h1 AS (SELECT node AS seed, node FROM nodes UNION SELECT x, y FROM either), h2 AS (SELECT seed, node FROM h1 UNION SELECT seed, y FROM h1 JOIN either ON x = node)"


@query("one_hop_pairs", W + ALL_NEAR_SQL + " SELECT seed, node FROM h1 UNION SELECT seed, xor(node, 1) FROM h1")
def one_hop_pairs(spark, d):
    r = fx.reads(spark, d)
    return graph.neighbourhoods(fx.clean_edges(r), fx.nodes(r), 1)


@query("two_hop_pairs", W + ALL_NEAR_SQL + " SELECT seed, node FROM h2 UNION SELECT seed, xor(node, 1) FROM h2")
def two_hop_pairs(spark, d):
    """Per node every node within two edges of it, complements too."""
    r = fx.reads(spark, d)
    return graph.neighbourhoods(fx.clean_edges(r), fx.nodes(r), 2)


@query("common_neighbours", W + fx.CLEAN_SQL + " SELECT c.src, c.dst, a.dst AS via FROM clean a JOIN clean b ON a.dst = b.src JOIN clean c ON c.src = a.src AND c.dst = b.dst")
def common_neighbours(spark, d):
    return graph.common_neighbours(fx.clean_edges(fx.reads(spark, d)))


@query(
    "shared_neighbours",
    W + fx.CLEAN_SQL + """, walk AS (SELECT src, dst FROM clean WHERE src NOT IN (SELECT dst FROM clean)), own AS (SELECT src AS node FROM walk UNION SELECT dst FROM walk
    UNION SELECT a.dst FROM walk w JOIN clean a ON a.src = w.src JOIN clean b ON b.src = a.dst AND b.dst = w.dst) SELECT node FROM own UNION SELECT xor(node, 1) FROM own""",
)
def shared_neighbours(spark, d):
    """Of the edges that leave tips."""
    e = fx.clean_edges(fx.reads(spark, d))
    return graph.shared_neighbours(e, e.join(graph.tips(e).withColumnRenamed("node", "src"), "src", "left_semi"))


@query(
    "shared_neighbours_pairs",
    W + fx.CLEAN_SQL + """, own AS (SELECT src, dst, src AS node FROM clean UNION SELECT src, dst, dst FROM clean
    UNION SELECT c.src, c.dst, a.dst FROM clean c JOIN clean a ON a.src = c.src JOIN clean b ON b.src = a.dst AND b.dst = c.dst) SELECT * FROM own UNION SELECT src, dst, xor(node, 1) FROM own""",
)
def shared_neighbours_pairs(spark, d):
    return graph.neighbours_shared_by_edge(fx.clean_edges(fx.reads(spark, d)))


CHAIN_TABLE_SQL = "chain AS (SELECT chr, b.day * 86400 AS t_start, (b.day + 1) * 86400 AS t_end, b.day * 86400 + (b.day - lo) * 100 AS q_start FROM (SELECT chr, min(s) // 86400 AS lo, max(s) // 86400 AS hi FROM r GROUP BY chr) c, LATERAL (SELECT unnest(range(lo, hi + 1)) AS day) b WHERE b.day % 10 <> 0)"


def chain_blocks(r: DataFrame) -> DataFrame:
    """Alignment blocks of a day each, some of them missing, that drift by 100 bases a day."""
    span = r.groupBy("chr").agg(F.expr("min(s) div 86400").alias("lo"), F.expr("max(s) div 86400").alias("hi"))
    blocks = span.select("chr", "lo", F.explode(F.sequence("lo", "hi")).alias("day")).where("day % 10 <> 0")
    return blocks.select("chr", (F.col("day") * 86400).alias("t_start"), ((F.col("day") + 1) * 86400).alias("t_end"), (F.col("day") * 86400 + (F.col("day") - F.col("lo")) * 100).alias("q_start"))


@query("liftover", W + fx.NODES_SQL + ", " + CHAIN_TABLE_SQL + " SELECT rid, s, coalesce(q_start + s - t_start, -1) AS lifted FROM r LEFT JOIN chain c ON c.chr = r.chr AND s >= t_start AND s < t_end")
def liftover(spark, d):
    r = fx.reads(spark, d)
    return joins.liftover(r.select("rid", "chr", F.col("s").alias("position")), chain_blocks(r), "rid").select("rid", F.col("position").alias("s"), F.coalesce("lifted", F.lit(-1)).alias("lifted"))


FINAL_SQL = "final AS (SELECT src, dst FROM edges WHERE (src * 5 + dst) % 11 = 0)"


@query("final_edge_flag", W + fx.EDGES_SQL + ", " + FINAL_SQL + " SELECT src, dst, (EXISTS (SELECT 1 FROM final f WHERE f.src = e.src AND f.dst = e.dst) OR EXISTS (SELECT 1 FROM final f WHERE f.src = xor(e.dst, 1) AND f.dst = xor(e.src, 1)))::INT AS hifiasm_result FROM edges e")
def final_edge_flag(spark, d):
    e = fx.edges(fx.reads(spark, d))
    return joins.final_edge_flag(e, e.where("(src * 5 + dst) % 11 = 0")).select("src", "dst", "hifiasm_result")


@query("final_edge_flag_blind", W + fx.EDGES_SQL + ", " + FINAL_SQL + ", pairs AS (SELECT DISTINCT least(src // 2, dst // 2) AS a, greatest(src // 2, dst // 2) AS b FROM final) SELECT src, dst, (EXISTS (SELECT 1 FROM pairs WHERE a = least(src // 2, dst // 2) AND b = greatest(src // 2, dst // 2)))::INT AS hifiasm_result FROM edges")
def final_edge_flag_blind(spark, d):
    e = fx.edges(fx.reads(spark, d))
    return joins.final_edge_flag(e, e.where("(src * 5 + dst) % 11 = 0"), oriented=False).select("src", "dst", "hifiasm_result")


@query("score_attach", W + fx.EDGES_SQL + " SELECT e.src, e.dst, coalesce(s.score, 0.5::DOUBLE) AS score FROM edges e LEFT JOIN (SELECT * FROM scored WHERE src % 3 = 0) s ON s.src = e.src AND s.dst = e.dst")
def score_attach(spark, d):
    e = fx.edges(fx.reads(spark, d))
    return joins.score_attach(e.select("src", "dst"), fx.scored(e).where("src % 3 = 0").select("src", "dst", "score"))


@query("node_scores", "SELECT 2 * event_id + k AS node, value AS graphic_score FROM events, (VALUES (0), (1)) AS t(k)")
def node_scores(spark, d):
    return joins.fan_out_scores(spark.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "event_id", "value")


#: Sampling by a fixed hash that both engines have; the library's own default is Spark's hash.
@query("sample_uniform", W + fx.EDGES_SQL + " SELECT src, dst FROM edges ORDER BY md5(src || '-' || dst), src, dst LIMIT 100")
def sample_uniform(spark, d):
    e = fx.edges(fx.reads(spark, d))
    return sampling.uniform(e, 100, F.md5(F.concat_ws("-", "src", "dst"))).select("src", "dst")


@query("union_distinct", W + fx.EDGES_SQL + " SELECT src, dst FROM clean UNION SELECT src, dst FROM edges")
def union_distinct(spark, d):
    r = fx.reads(spark, d)
    return fx.clean_edges(r).select("src", "dst").union(fx.edges(r).select("src", "dst")).distinct()


@query("intersect_edges", W + TORN_SQL + " SELECT src, dst FROM clean INTERSECT SELECT src, dst FROM torn")
def intersect_edges(spark, d):
    r = fx.reads(spark, d)
    return fx.clean_edges(r).select("src", "dst").intersect(torn(fx.edges(r)).select("src", "dst"))


@query("except_edges", W + fx.EDGES_SQL + " SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM clean")
def except_edges(spark, d):
    r = fx.reads(spark, d)
    return fx.edges(r).select("src", "dst").subtract(fx.clean_edges(r).select("src", "dst"))


@query("dict_sum_merge", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1) GROUP BY 1")
def dict_sum_merge(spark, d):
    """Per type its events and its users, added up."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("k"), "user_id")
    count = F.count(F.lit(1)).alias("n")
    return joins.sum_merge(events.groupBy("k").agg(count), events.distinct().groupBy("k").agg(count), "k", "n")


@query("min_max_coalesce", W + fx.NODES_SQL + ' SELECT node, least("read_start_M", "read_start_P") AS start, greatest("read_end_M", "read_end_P") AS "end" FROM nodes')
def min_max_coalesce(spark, d):
    return fx.nodes(fx.reads(spark, d)).select("node", F.least("read_start_M", "read_start_P").alias("start"), F.greatest("read_end_M", "read_end_P").alias("end"))
