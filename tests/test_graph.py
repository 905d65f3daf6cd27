"""Hand-computed cases of the graph operators."""

import pytest
from pyspark.sql import functions as F

from pairstrand.functions import strings
from pairstrand.functions.predicates import is_correct_edge
from pairstrand.operators import components, cuts, decode, graph, labels, metrics, sampling, score, simplify
from pairstrand.sources import formats


def edges(spark, rows, schema="src long, dst long, prefix_length long"):
    return spark.createDataFrame(rows, schema)


def both(rows):
    """Rows (src, dst, prefix) with mirrors of the same prefix."""
    return rows + [(d ^ 1, s ^ 1, p) for s, d, p in rows]


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_complement_and_reverse_complement(spark):
    df = spark.createDataFrame([(0, "ACGTN"), (1, "acgtRYK"), (6, "")], "n long, s string")
    got = df.select(strings.complement(F.col("n")).alias("c"), strings.reverse_complement(F.col("s")).alias("r")).collect()
    assert [(r["c"], r["r"]) for r in got] == [(1, "NACGT"), (0, "MRYacgt"), (7, "")]


def test_orient_expand(spark):
    links = spark.createDataFrame([("a", "+", "b", "-", 3)], "id1 string, orient1 string, id2 string, orient2 string, overlap_length long")
    segments = spark.createDataFrame([("a", 0, 10), ("b", 1, 20)], "seg_id string, index long, length long")
    assert pairs(formats.segment_edges(links, segments)) == [(0, 3), (2, 1)]


def test_triangle_theta(spark):
    e = edges(spark, both([(0, 2, 100), (2, 4, 100), (0, 4, 200)]))
    assert pairs(simplify.triangle_theta(e)) == [(0, 4), (5, 1)]
    assert pairs(simplify.transitive_reduction(e)) == [(0, 2), (2, 4), (3, 1), (5, 3)]


@pytest.mark.parametrize(
    ("src", "dst", "strand", "want"),
    [((0, 100), (50, 150), 1, True), ((0, 100), (100, 200), 1, False), ((0, 100), (20, 80), 1, False), ((50, 150), (0, 100), 1, False), ((50, 150), (0, 100), -1, True), ((None, 100), (50, 150), 1, False)],
)
def test_is_correct_edge(spark, src, dst, strand, want):
    df = spark.createDataFrame([(*src, *dst, strand)], "a long, b long, c long, d long, s int")
    assert df.select(is_correct_edge(*(F.col(x) for x in "abcds")).alias("x")).first()["x"] is want


def test_mirror_average(spark):
    e = edges(spark, [(0, 2, 0.1), (3, 1, 0.9)], "src long, dst long, score double")
    assert {round(r["score"], 6) for r in score.mirror_average(e).collect()} == {0.5}
    assert {round(r["score"], 6) for r in score.mirror_average(e, compat=True).collect()} == {0.7}


def test_reduction(spark):
    e = edges(spark, [(0, 2, 0.4), (3, 1, 0.6), (2, 4, 0.1), (5, 3, 0.2)], "src long, dst long, score double")
    kept = cuts.reduction(e, "score", 0.5)
    assert pairs(kept) == [(2, 4), (5, 3)]
    assert pairs(cuts.reduction(kept, "score", 0.5)) == pairs(kept)
    assert pairs(cuts.reduction(e, "score", 0.5, restore=True)) == [(0, 2), (2, 4), (3, 1), (5, 3)]


def test_lengths(spark):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate([50, 30, 20])], "hap string, walk_id long, length long")
    assert metrics.n50(df).first()["n50"] == 50
    assert metrics.n50(df, 150).first()["n50"] == 30
    assert metrics.n50(df, 400).first()["n50"] == 0
    assert metrics.lg90(df, 100).first()["lg90"] == 3
    same = spark.createDataFrame([("p", i, 10) for i in range(10)], "hap string, walk_id long, length long")
    assert metrics.lg90(same, 100).first()["lg90"] == 9


def walks(spark, *paths, hap="p"):
    return spark.createDataFrame([(hap, k, i, x) for k, p in enumerate(paths) for i, x in enumerate(p)], "hap string, walk_id long, pos long, node long")


def test_phasing_errors(spark):
    y = spark.createDataFrame([(2 * i, v) for i, v in enumerate([1, 1, -1, 0, -1, 1])], "node long, y int")
    got = metrics.phasing_errors(walks(spark, [0, 2, 4, 6, 8, 10]), y, "y").first()
    assert (got["switch"], got["hamming"]) == (0.2, 0.8)


def test_contig_length_and_sequence(spark):
    w = walks(spark, [0, 2, 4])
    n = spark.createDataFrame([(x, 100, "ACGTACGTAC") for x in (0, 2, 4)], "node long, read_length long, seq string")
    e = edges(spark, [(0, 2, 40), (2, 4, 30)], "src long, dst long, overlap_length long")
    assert metrics.contig_lengths(w, n, e).first()["length"] == 230
    short = edges(spark, [(0, 2, 4), (2, 4, 10)], "src long, dst long, overlap_length long")
    assert metrics.walk_to_seq(w, n, short).first()["seq"] == "ACGTACGTACACGTAC"


def test_kmer_error(spark):
    n = spark.createDataFrame([(0, 100, 0.0, 0.0), (2, 100, 8.0, 2.0)], "node long, read_length long, kmer_count_p double, kmer_count_m double")
    e = edges(spark, [(0, 2, 50)], "src long, dst long, overlap_length long")
    assert metrics.kmer_error(walks(spark, [0, 2]), n, e).first()["kmer_error"] == 0.2


def test_trio_labels(spark):
    df = spark.createDataFrame([(i, c, 1000.0, 2000.0) for i, c in enumerate("pm0ax")], "node long, trio_label string, strong_pat double, strong_mat double")
    got = {r["node"]: (r["yak_p"], r["yak_m"], r["ambiguous"], r["yak_region"]) for r in labels.trio_labels(df).collect()}
    assert got == {0: (1, -1, 0, "E"), 1: (-1, 1, 0, "E"), 2: (0, 0, 0, "O"), 3: (0, 0, 1, "O"), 4: (None, None, None, None)}


def test_beam_edge_score(spark):
    df = spark.range(1).select(score.beam_edge_score(F.lit(20000), F.lit(10000), F.lit(0.2), F.lit(0.01)).alias("g"), score.beam_edge_score(F.lit(20000), F.lit(10000), F.lit(None).cast("double"), F.lit(0.0)).alias("h"))
    r = df.first()
    assert round(r["g"], 9) == -0.2625 and round(r["h"], 9) == 0.1


def test_condense(spark):
    n = spark.createDataFrame([(x, 100, 0.5, 0, 100, None, None, "c", 1) for x in range(6)], "node long, read_length long, support double, read_start_M long, read_end_M long, read_start_P long, read_end_P long, read_chr string, read_strand int")
    e = spark.createDataFrame([(0, 2, 40, 60), (2, 4, 30, 70), (3, 1, 40, 60), (5, 3, 30, 70)], "src long, dst long, overlap_length long, prefix_length long")
    nodes, rest, members = simplify.condense(n, e)
    assert sorted((r["node"], r["read_length"]) for r in nodes.collect()) == [(6, 230), (7, 230)]
    assert rest.count() == 0
    assert sorted((r["node"], r["pos"], r["old"]) for r in members.collect()) == [(6, 0, 0), (6, 1, 2), (6, 2, 4), (7, 0, 5), (7, 1, 3), (7, 2, 1)]


def test_condense_leaves_cycles(spark):
    e = spark.createDataFrame([(0, 2, 1, 1), (2, 4, 1, 1), (4, 0, 1, 1), (6, 8, 1, 1)], "src long, dst long, overlap_length long, prefix_length long")
    assert sorted((r["head"], r["node"], r["pos"]) for r in simplify.chains(e).collect()) == [(6, 6, 0), (6, 8, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    e = spark.createDataFrame(chain + [(900, 901)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.wcc(e).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[901] == 900
    assert components.wcc(e.limit(0)).count() == 0
    assert components.is_dag(e)
    assert not components.is_dag(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))


def test_deadends(spark):
    n = spark.createDataFrame([(1, 0, 10), (2, 5, 20), (3, 15, 30), (4, 16, 18)], "node long, s long, e long")
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src long, dst long")
    assert [r["node"] for r in components.deadends(n, e, "s", "e").collect()] == [4]


def test_trap_edges(spark):
    e = spark.createDataFrame([(0, 2, 1), (2, 4, 0), (0, 6, 1), (8, 0, 1)], "src long, dst long, gt_bin int")
    got = {(r["src"], r["dst"]): r["trap"] for r in labels.trap_edges(e).collect()}
    assert got == {(0, 2): 1, (2, 4): 0, (0, 6): 0, (8, 0): 0}


def test_deadends_has_no_last_sweep(spark):
    lone = [(10 + k, k, k + 1) for k in range(1100)]
    n = spark.createDataFrame([*lone, (1, 2000, 2010), (2, 2005, 2020), (3, 2015, 2030), (4, 2016, 2018), (5, 2017, 2019), (6, 2018, 2020), (7, 2019, 2021)], "node long, s long, e long")
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (5, 6), (6, 7)], "src long, dst long")
    assert {r["node"] for r in components.deadends(n, e, "s", "e").collect()} == {4, 5, 6, 7, *(k for k, _, _ in lone)}


def test_trap_edges_has_no_last_round(spark):
    chain, ring = [(k, k + 1, 1) for k in range(1100)], [(5000, 5001, 1), (5001, 5000, 1)]
    e = spark.createDataFrame([*chain, (1100, 1101, 0), *ring, (3000, 0, 1), (3000, 5000, 1), (3001, 3000, 1)], "src long, dst long, gt_bin int")
    got = {(r["src"], r["dst"]): r["trap"] for r in labels.trap_edges(e).collect()}
    assert got == {**{(a, b): 1 for a, b, _ in chain}, (1100, 1101): 0, (5000, 5001): 0, (5001, 5000): 0, (3000, 0): 1, (3000, 5000): 0, (3001, 3000): 0}


def test_comp_dist_query_has_no_last_step(spark, tmp_path):
    """A chain of 18 reads whose only turn lies at its end: 16 edges there, the turn, and 17 back."""
    from pairstrand.plans.catalog import QUERIES

    ids = [*[k for k in range(1, 26) if k % 3][:16], 27, 28]
    rows, s = [], 1_700_000_000
    for i in ids:
        rows.append((i, s, 1, "x", 1.0))
        s += 20 * (1800 + 300 * (i * 7 % 13)) - 1000
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["node"]: r["comp_dist"] for r in QUERIES["comp_dist"](spark, str(tmp_path)).collect()}
    assert [got[2 * i] for i in ids] == [34 - 2 * k for k in range(17)] + [-1]
    assert all(got[2 * i + 1] == -1 for i in ids)


def test_neighbourhoods_of_every_node_and_edge(spark):
    n = spark.createDataFrame([(k,) for k in range(6)], "node long")
    e = spark.createDataFrame([(0, 2), (2, 4), (0, 4)], "src long, dst long")
    near = {(r["seed"], r["node"]) for r in graph.neighbourhoods(e, n, 1).collect()}
    assert near == {(a, b) for a in (0, 2, 4) for b in range(6)} | {(a, b) for a in (1, 3, 5) for b in (a, a - 1)}
    shared = {(r["src"], r["dst"], r["node"]) for r in graph.neighbours_shared_by_edge(e).collect()}
    assert shared == {(0, 4, k) for k in range(6)} | {(0, 2, k) for k in range(4)} | {(2, 4, k) for k in range(2, 6)}
    reach = {(r["start"], r["node"]) for r in components.reachable_pairs(e, n).collect()}
    assert reach == {(k, k) for k in range(6)} | {(0, 2), (0, 4), (2, 4)}


def test_liftover_misses_and_strands(spark):
    from pairstrand.operators.joins import liftover

    chain = spark.createDataFrame([("c", 0, 10, 100, "+", 500), ("c", 20, 30, 0, "-", 500)], "chr string, t_start long, t_end long, q_start long, q_strand string, q_size long")
    p = spark.createDataFrame([(1, "c", 5), (2, "c", 15), (3, "c", 21), (4, "d", 5)], "id long, chr string, position long")
    assert {r["id"]: r["lifted"] for r in liftover(p, chain, "id", 8).collect()} == {1: 105, 2: None, 3: 498, 4: None}


def test_decode_walks_a_chain(spark):
    k = 8
    rows = [(2 * i, 2 * i + 2, 1000, 9000, 0.0, 0.0) for i in range(k)]
    rows += [(b ^ 1, a ^ 1, o, p, x, y) for a, b, o, p, x, y in rows]
    e = spark.createDataFrame(rows, "src long, dst long, overlap_length long, prefix_length long, score double, to_cut double")
    n = spark.createDataFrame([(i, 10000, 0.0, 0.0) for i in range(2 * k + 2)], "node long, read_length long, kmer_count_p double, kmer_count_m double")
    s = decode.Strategy(min_component_size=3, min_path_length=5, min_walk_length=50_000)
    got = decode.get_walks(n, e, s, ["p", "m"])
    paths = {(r["hap"], r["walk_id"]): r["p"] for r in got.groupBy("hap", "walk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("p")).collect()}
    want = [2 * i for i in range(k + 1)]
    assert set(paths) == {("p", "0.0"), ("m", "0.0")}
    assert all(p in (want, [x ^ 1 for x in reversed(want)]) for p in paths.values())
    assert decode.get_walks(n, e, decode.Strategy(min_component_size=3, min_path_length=5, min_walk_length=10**9), None).count() == 0


def test_sampling(spark):
    e = spark.createDataFrame([(i, i + 1, float(i % 3)) for i in range(50)], "src long, dst long, w double")
    assert sampling.uniform(e, 10).distinct().count() == 10
    assert sampling.uniform(e, 100).count() == 50
    got = sampling.weighted(e, 20, "w").collect()
    assert len(got) == 20 and all(r["w"] > 0 for r in got)


def test_invariants_are_checked(spark):
    n = spark.createDataFrame([(0,), (1,), (2,), (3,)], "node long")
    good = spark.createDataFrame([(0, 2), (3, 1)], "src long, dst long")
    graph.assert_invariants(n, good)
    with pytest.raises(ValueError, match="mirror"):
        graph.assert_invariants(n, good.limit(1))


# -- formats ---------------------------------------------------------------------------------------------------------


def test_gfa_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(0, 7, 0.25, "ACGTACG"), (1, 7, 0.25, "CGTACGT"), (2, 5, None, "*"), (3, 5, None, "*")], "node long, read_length long, support double, seq string")
    e = spark.createDataFrame([(0, 3, 4), (2, 1, 4)], "src long, dst long, overlap_length long")
    formats.write_gfa(n, e, str(tmp_path / "g"))
    split = formats.fields(formats.numbered_lines(spark, str(tmp_path / "g")))
    s = {r["seg_id"]: (r["seq"], r["length"], r["support"]) for r in formats.scan_gfa_s(split, 100).collect()}
    assert s == {"utg000000": ("ACGTACG", 7, 0.25), "utg000001": ("*****", 5, 0.01)}
    assert [tuple(r) for r in formats.scan_gfa_l(split).collect()] == [("utg000000", "+", "utg000001", "-", 4)]


def test_gfa_link_dialects_and_errors(spark):
    lines = lambda *x: formats.fields(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "line_no long, value string"))
    got = formats.scan_gfa_l(lines("L\ta:1-20\t+\tb:3-9\t-\t5M\tL1:i:3", "", "L a + b - 6M L1:i:3 L2:i:4")).collect()
    assert [(r["id1"], r["id2"], r["overlap_length"]) for r in got] == [("a", "b", 5), ("a", "b", 6)]
    with pytest.raises(Exception, match="without a whole overlap"):
        formats.scan_gfa_l(lines("L a + b - xM")).collect()
    with pytest.raises(Exception, match="fields"):
        formats.scan_gfa_l(lines("L a + b 6M")).collect()


def test_reads(spark, tmp_path):
    (tmp_path / "r.fasta").write_text(">read=42,m/1,pos\nACG\nTT\n>x strand=- start=5 end=9 variant=P chr=2\nAC\n")
    (tmp_path / "r.fastq").write_text("@x strand=+ start=5 end=9 variant=M chr=2\nACGT\n+\nIIII\n@y\nGG\n+\nII\n")
    got = {r["read_id"]: r["seq"] for r in formats.scan_reads(spark, str(tmp_path / "r.fasta")).collect()}
    assert got == {"42": "ACGTT", "x": "AC"}
    rows = formats.parse_headers(formats.scan_reads(spark, str(tmp_path / "r.fastq"))).orderBy("read_id").collect()
    assert [(r["read_id"], r["seq"], r["read_strand"], r["read_start"], r["variant"], r["read_chr"]) for r in rows] == [("x", "ACGT", 1, 5, "M", "2"), ("y", "GG", None, None, None, None)]
    assert formats.filetype("a/b.fq.gz") == "fastq"
    with pytest.raises(ValueError, match="neither"):
        formats.filetype("a.txt")


def test_reports(spark, tmp_path):
    lines = lambda text: spark.createDataFrame([(i, v) for i, v in enumerate(text.split("\n"))], "line_no long, value string")
    assert {r["tag"]: r["rate"] for r in formats.scan_yak_eval(lines("W 1 10 0.1\nH 2 10 0.2\nW 3 10 0.3")).collect()} == {"W": 0.3, "H": 0.2}
    got = {r["metric"]: r["value"] for r in formats.scan_assembly_report(lines("NG50 5\nNG50 7\nRdup 0.5")).collect()}
    assert got == {"NG50": 7.0, "NGA50": 0.0, "Length": 0.0, "Rdup": 0.5}
    blocks = formats.scan_chain(lines("chain 9 chr1 100 + 10 40 chrA 90 + 3 30 1\n5 2 1\n7")).orderBy("t_start").collect()
    assert [(r["chr"], r["t_start"], r["t_end"], r["q_chr"], r["q_start"]) for r in blocks] == [("chr1", 10, 15, "chrA", 3), ("chr1", 17, 24, "chrA", 9)]
    (tmp_path / "t.tsv").write_text("utg000007\tp\t10\t20\t0\t0\n")
    assert tuple(formats.scan_trio(spark, str(tmp_path / "t.tsv")).first()) == (7, "p", 10.0, 20.0)


def test_wrong_runs_are_rerouted(spark):
    """4 is of the wrong haplotype; 8 goes round it. 12 is wrong too, but the way round it is no lighter."""
    from pairstrand.operators import refine

    n = spark.createDataFrame([(x, 100, -1 if x in (4, 12, 16) else 1) for x in range(0, 20, 2)], "node long, read_length long, y int")
    e = spark.createDataFrame([(0, 2), (2, 4), (4, 6), (2, 8), (8, 6), (6, 12), (12, 14), (6, 16), (16, 14)], "src long, dst long")
    w = walks(spark, [0, 2, 4, 6, 12, 14])
    got = refine.fix_bubbles(w, e, n, "y").orderBy("pos").collect()
    assert [(r["pos"], r["node"]) for r in got] == list(enumerate([0, 2, 8, 6, 12, 14]))
    row = refine.reroute(w, e, n, "y").first()
    assert (row["cost"], row["path"]) == (100, [0, 2, 8, 6, 12, 14])
    assert refine.lightest_ways(e.withColumn("weight", F.lit(1)), spark.createDataFrame([(1, 14, 0)], "k int, start long, end long"), ["k"]).count() == 0


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    n = 0
    for name, k in (("a.txt", 3000), ("b.txt", 3), ("c.txt", 1000)):
        (tmp_path / name).write_text("".join(f"{n + i} {'x' * (i * 7 % 40)}\n" for i in range(k)))
        n += k
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = formats.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1 and lines.count() == n
        assert lines.where(F.split("value", " ")[0].cast("long") != F.col("line_no")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("seed", "mirrored"), [(1, True), (2, False)])
def test_ways_to_complements(spark, seed, mirrored):
    """Distances as by breadth-first search, ways that are ways of that length, and counts of their edges."""
    import random
    from collections import Counter, deque

    rng, edges = random.Random(seed), set()
    for _ in range(130):
        a = rng.randrange(80)
        b = min(79, max(0, a + rng.randint(-9, 9)))
        edges |= {(a, b), (b ^ 1, a ^ 1)} if mirrored else {(a, b)}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def distance(s):
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in out.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen.get(s ^ 1, -1)

    nodes, e = spark.range(84).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(edges), "src long, dst long")
    want = {s: distance(s) for s in range(84)}
    assert {r["node"]: r["comp_dist"] for r in components.comp_dist(nodes, e).collect()} == want
    ways = {r["node"]: r["path"] for r in components.comp_ways(nodes.where("node % 2 = 0"), e).collect()}
    assert {s: len(p) - 1 for s, p in ways.items()} == {s: d for s, d in want.items() if d >= 0 and s % 2 == 0} and len(ways) > 3
    plain, normal = Counter(), Counter()
    for s, p in ways.items():
        steps = list(zip(p[:-1], p[1:], strict=True))
        assert p[0] == s and p[-1] == s ^ 1 and set(steps) <= edges
        for a, b in steps:
            for x in ((a, b), (b ^ 1, a ^ 1)):
                plain[x] += 1
                normal[x] += 1 / len(steps)
    for r in components.edge_usage(nodes, e).collect():
        x = (r["src"], r["dst"])
        assert r["ec_count"] == pytest.approx(plain[x] / 84) and r["ec_count_normal"] == pytest.approx(normal[x] / 84)


def test_no_way_to_a_complement(spark):
    e = spark.createDataFrame([(0, 2), (2, 4)], "src long, dst long")
    assert components.comp_ways(spark.range(6).withColumnRenamed("id", "node"), e).count() == 0
    assert {r["ec_count"] for r in components.edge_usage(spark.range(6).withColumnRenamed("id", "node"), e).collect()} == {0.0}


def test_deadends_against_a_plain_sweep(spark):
    """Sweep by sweep: the node that begins first, what it reaches, and the ways to the node of these that ends last."""
    import random

    rng = random.Random(3)
    start = {x: rng.randint(0, 500) for x in range(60)}
    end = {x: s + rng.randint(5, 40) for x, s in start.items()}
    edges = {(a, b) for a in range(60) for b in rng.sample(range(60), 3) if start[a] < start[b] <= start[a] + 90 and a // 20 == b // 20}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(s, inside):
        seen, todo = {s}, [s]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y in inside and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    left, good, furthest = set(range(60)), set(), -1
    while left:
        s = min(left, key=lambda x: (start[x], x))
        found = reach(s, left)
        left -= found
        top = max(found, key=lambda x: (end[x], -x))
        if len(found) > 2 and end[top] >= furthest:
            good |= {x for x in found if top in reach(x, found)}
        if len(found) > 2:
            furthest = max(furthest, end[top])
    nodes = spark.createDataFrame([(x, start[x], end[x]) for x in range(60)], "node long, s long, e long")
    got = {r["node"] for r in components.deadends(nodes, spark.createDataFrame(sorted(edges), "src long, dst long"), "s", "e").collect()}
    assert got == set(range(60)) - good and good


def test_ladders_take_few_rounds(spark, monkeypatch):
    """10,000 rungs: whether there is a cycle, and what is reached, in rounds far under the longest way."""
    made = []
    write = components.written
    monkeypatch.setattr(components, "written", lambda df, kind, *more: made.append(kind) or write(df, kind, *more))
    n = 10_000
    rung = spark.range(n)
    ladder = rung.select((4 * F.col("id")).alias("src"), (4 * F.col("id") + 4).alias("dst")).union(rung.select(4 * F.col("id") + 2, 4 * F.col("id") + 6)).union(rung.select(4 * F.col("id"), 4 * F.col("id") + 2)).cache()
    assert components.is_dag(ladder)
    assert not components.is_dag(ladder.union(spark.createDataFrame([(4 * n + 2, 8)], "src long, dst long")))
    assert components.reachable(ladder, spark.createDataFrame([(4 * 9000,), (7,)], "node long")).count() == 2 * 1001 + 1  # the second start is by itself
    assert len(made) < 150


@pytest.mark.parametrize("seed", range(6))
def test_is_dag_and_reachable_on_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    edges = set()
    for _ in range(rng.choice([40, 90])):
        a, b = sorted(rng.sample(range(50), 2))
        edges.add((a, b) if rng.random() > 0.02 * seed else (b, a))
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(s):
        seen, todo = set(), [s]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert components.is_dag(e) == (not any(x in reach(x) for x in range(50)))
    starts = rng.sample(range(60), 3)
    got = {r["node"] for r in components.reachable(e, spark.createDataFrame([(x,) for x in starts], "node long")).collect()}
    assert got == set(starts).union(*(reach(x) for x in starts))


def test_reads_without_coordinates_are_placed(spark):
    """From the read before by lengths less a tenth, at most 1,500 bases; at the beginning from the next one."""
    lengths = [1000, 2000, 20_000, 1000, 1000]
    starts = [None, 5000, None, None, 90_000]
    placements = spark.createDataFrame([("u", k, 10 * k, f"r{k}") for k in range(5)] + [("u", 9, 5, "p"), ("v", 7, 0, "q")], "seg_id string, line_no int, offset int, read_id string")
    reads = [(f"r{k}", "M", n, s, None if s is None else s + n) for k, (n, s) in enumerate(zip(lengths, starts, strict=True))] + [("p", "P", 100, 7, 107), ("q", "M", 100, None, None)]
    out = labels.infer_read_coords(placements, spark.createDataFrame(reads, "read_id string, variant string, read_length long, read_start long, read_end long"))
    got = {r["read_id"]: (r["read_start"], r["read_end"], r["inferred"]) for r in out.collect()}
    assert got == {
        "r0": (5000 - 900, 5100, True), "r1": (5000, 7000, False), "r2": (6800, 26_800, True), "r3": (6800 + 18_500, 26_300, True), "r4": (90_000, 91_000, False), "p": (7, 107, False), "q": (None, None, False),
    }
    spans = {r["seg_id"]: tuple(r)[1:] for r in labels.unitig_spans(out).collect()}
    assert spans == {"u": (4100, 91_000, 7, 107), "v": (None, None, None, None)}


def test_build_graph_with_a_final_assembly(spark):
    """Segments of one read each, one of two; the assembly joins two segments anew, and holds a read that no segment has."""
    lines = [
        "S\tutg1\t*\tLN:i:1000\trd:i:9", "S\tutg2\t*\tLN:i:1000\trd:i:9", "S\tutg3\t*\tLN:i:1800\trd:i:9", "L\tutg1\t+\tutg2\t+\t400M",
        "A\tutg1\t0\t+\tr1\t0\t1000\tid:i:0\tHG:A:a", "A\tutg2\t0\t-\tr2\t0\t1000\tid:i:1\tHG:A:a", "A\tutg3\t0\t+\tr3\t0\t1000\tid:i:2\tHG:A:a", "A\tutg3\t800\t+\tr4\t0\t1000\tid:i:3\tHG:A:a",
    ]
    split = formats.fields(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    reads = spark.createDataFrame([(f"r{k}", 1, 600 * k, 600 * k + 1000, "M", "chr1") for k in range(1, 7)], "read_id string, read_strand int, read_start long, read_end long, variant string, read_chr string")
    final = spark.createDataFrame([("r1", "+", "r2", "-", 600), ("r2", "-", "r5", "+", 650), ("r3", "+", "r4", "+", 600)], "read_a string, orient_a string, read_b string, orient_b string, prefix long")
    nodes, edges = formats.build_graph(split, reads, final=final)
    plain_nodes, plain_edges = formats.build_graph(split, reads)
    assert plain_nodes.count() == 6 and plain_edges.count() == 2 and "hifiasm_result" not in plain_edges.columns
    got = {r["node"]: (r["read_length"], r["read_strand"], r["read_start_M"]) for r in nodes.collect()}
    assert len(got) == 8 and got[6] == (1000, 1, 3000) and got[7] == (1000, -1, 3000)
    known = {(r["src"], r["dst"]): (r["overlap_length"], r["prefix_length"], r["hifiasm_result"]) for r in edges.collect()}
    # r2 lies backward in its segment, so r2- is the segment's forward node 2
    assert known == {(0, 2): (400, 600, 1), (3, 1): (400, 600, 1), (2, 6): (350, 650, 1), (7, 3): (350, 650, 1)}
