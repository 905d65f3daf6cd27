"""What queries do on tables that grow: nothing large is broadcast, nothing is derived twice, nothing is left out."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairstrand.functions.strings import IUPAC, IUPAC_COMPLEMENT
from pairstrand.operators import components, decode, graph, labels, metrics, score, simplify, training, vectors
from pairstrand.plans import walk_queries
from pairstrand.plans.catalog import QUERIES
from pairstrand.plans.walk_queries import SIZE, WEIGHTS, _vectors
from pairstrand.sources import fixture as fx
from pairstrand.sources import formats
from pairstrand.sources.shared import bucketed, forget, written

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neither_reads_nor_vectors_are_broadcast(spark):
    """Reads and vectors compress to a few per cent: a table that the planner takes for small filled the driver."""
    r = fx.reads(spark, str(DATA))
    assert "BroadcastExchange" not in plan(fx.edges(r))
    assert "BroadcastExchange" not in plan(fx.user_graph(r))
    h, e = _vectors(spark, str(DATA))
    for made in score.gated_conv(h, e, WEIGHTS, SIZE):
        assert "BroadcastExchange" not in plan(made)


def test_contigs_are_spelled_once(spark, tmp_path):
    """Each evaluation spells other letters here, so FASTA that is spelled anew isn't that of the Parquet table."""
    walks = spark.createDataFrame([("p", 2, 0, 2), ("m", 4, 0, 4)], "hap string, walk_id long, pos int, node long")
    contigs = walks.select("hap", "walk_id", F.expr("uuid()").alias("seq"), F.col("walk_id").alias("contig_id"))
    formats.write_walks(walks, contigs, str(tmp_path / "w"))
    kept = {r["seq"] for r in spark.read.parquet(str(tmp_path / "w" / "contigs")).collect()}
    fasta = {r["seq"] for name in ("hap1", "hap2") for r in formats.scan_fasta(spark, str(tmp_path / "w" / f"{name}.fasta")).collect()}
    assert kept == fasta


def test_kmers_of_a_long_sequence(spark, monkeypatch):
    """Held against plain Python, across the stretches that a sequence is looked at in; no place becomes a row of text on its way."""
    monkeypatch.setattr(metrics, "PLACES", 7)
    turn = str.maketrans(IUPAC, IUPAC_COMPLEMENT)
    canon = lambda s: [min(w, w[::-1].translate(turn)) for w in (s[i : i + 5] for i in range(len(s) - 4))]
    texts = {"a": "ACGTTKYRNNACGTAACCGGTTACGTTACGATTACA" * 3, "b": "TGTAATCGTAACG", "c": "ACG", "d": None}
    reads = spark.createDataFrame(list(texts.items()), "read_id string, seq string")
    sets = metrics.kmers(reads.withColumn("parent", F.when(F.col("read_id") == "a", "p").otherwise("m")), 5)
    assert {(r["parent"], r["kmer"]) for r in sets.collect()} == {("p" if k == "a" else "m", w) for k, s in texts.items() if s for w in canon(s)}
    of = {"p": set(canon(texts["a"])), "m": set(canon(texts["b"]))}
    want = {(k, p): n for k, s in texts.items() if s for p in of if (n := sum(w in of[p] for w in canon(s)))}
    hits = metrics.kmer_hits(reads, sets, 5)
    assert {(r["read_id"], r["parent"]): r["hits"] for r in hits.collect()} == want
    assert "Generate" not in plan(hits)


def test_pairs_are_given_whole(spark):
    """The pairs themselves, not how many there are."""
    for name, seed in (("reachability_pairs", "start"), ("two_hop_pairs", "seed")):
        assert QUERIES[name](spark, str(DATA)).columns == [seed, "node"]


def test_statistics_derive_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(100).select(counted("id").alias("v"))
    assert simplify.edge_stats(rows, "v").first()["median"] == 49.5
    assert seen.value == 100


def test_segments_beyond_six_digits_keep_their_names(spark):
    """names cut to six digits made ten segments one, and their edges a hundred."""
    nodes = spark.createDataFrame([(2 * i + k, 5000, 1.0) for i in (1_234_560, 1_234_561, 123_456) for k in (0, 1)], "node long, read_length long, support double")
    edges = spark.createDataFrame([(2 * a, 2 * b, 100) for a, b in ((1_234_560, 1_234_561), (1_234_561, 123_456))], "src long, dst long, overlap_length long")
    edges = edges.union(edges.selectExpr("dst ^ 1L", "src ^ 1L", "overlap_length"))
    segments = formats.scan_gfa_s(formats.fields(formats.gfa_s_lines(nodes))).withColumn("index", F.expr("cast(substring(seg_id, 4) as bigint)"))
    back = formats.segment_edges(formats.scan_gfa_l(formats.fields(formats.gfa_l_lines(edges))), segments)
    assert {r["seg_id"] for r in segments.collect()} == {"utg1234560", "utg1234561", "utg123456"}
    assert sorted((r["src"], r["dst"]) for r in back.collect()) == sorted((r["src"], r["dst"]) for r in edges.collect())


def test_reduction_derives_edges_once(spark):
    """each step of the search for ways of two edges derived the overlaps anew."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(0, 2, 10), (2, 4, 10), (0, 4, 20), (3, 1, 10), (5, 3, 10), (5, 1, 20)], "src long, dst long, p long")
    left = simplify.transitive_reduction(edges.select("src", "dst", counted("p").alias("prefix_length")))
    assert sorted((r["src"], r["dst"]) for r in left.collect()) == [(0, 2), (2, 4), (3, 1), (5, 3)]
    assert seen.value == 6


def test_pairs_are_not_shuffled_by_themselves(spark):
    """every round of the search for pairs shuffled all pairs, and the complements did so again."""
    edges = spark.createDataFrame([(0, 2), (2, 4), (4, 6), (4, 4), (8, 2), (3, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (4,), (9,), (0,)], "node long")
    near = {}
    for a, b in [(r["src"], r["dst"]) for r in edges.collect()]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for hops in (0, 1, 2, 3):
        want = set()
        for s in (0, 4, 9):
            held = {s}
            for _ in range(hops):
                held |= {y for x in held for y in near.get(x, ())}
            want |= {(s, x ^ k) for x in held for k in (0, 1)}
        found = graph.neighbourhoods(edges, seeds, hops)
        assert sorted((r["seed"], r["node"]) for r in found.collect()) == sorted(want)
        assert plan(found).index("Generate") < plan(found).index("Exchange")


def test_training_rows_derive_edges_once(spark, monkeypatch):
    """degrees, labels and features each derived the edges anew, and so did the regression's passes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    r, n, e = walk_queries.tables(spark, str(DATA))
    monkeypatch.setattr(walk_queries, "tables", lambda *_: (r, n, e.withColumn("overlap_length", counted("overlap_length"))))
    QUERIES["train_logreg"](spark, str(DATA)).collect()
    assert seen.value == e.count()


def test_a_step_opens_its_own_parts(spark):
    """steps looked through all parts, and parts without edges of a use were run for it."""
    nodes = spark.range(8).withColumnRenamed("id", "node")
    own = nodes.select("node", F.floor(F.col("node") / 2).cast("int").alias("part"))
    x = nodes.select("node", F.array(F.col("node") / 8.0).alias("x"))
    rows = [(0, 1, 1, training.TRAIN), (2, 3, 0, training.VALID), (4, 5, 1, training.TRAIN), (4, 6, 0, training.OTHER)]
    labelled = spark.createDataFrame(rows, "src long, dst long, target int, use int")
    edges = labelled.select("src", "dst", F.array(F.lit(1.0)).alias("e"))
    parts = training.packed_parts(own, x, edges, labelled)
    assert {r["part"]: r["uses"] for r in parts.collect()} == {0: [training.TRAIN], 1: [training.VALID], 2: [training.TRAIN, training.OTHER], 3: []}
    assert "PartitionFilters: [part" in plan(parts.where(F.col("part").isin([0, 2])))
    w = training.new_weights(1, 1, training.Settings(size=3, layers=1, hidden=2))
    loss, n, _ = training.gradient(parts, w, 1.0, 0.1)
    assert n == 2 and loss > 0
    assert training.gradient(parts.where("part = 1"), w, 1.0, 0.1)[:2] == (0.0, 0)


def test_traps_write_what_a_round_adds(spark, monkeypatch):
    """each round wrote all edges anew. Held against plain Python, edges that are neither right nor wrong included."""
    rng = random.Random(6)
    rows = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    rows = [(a, b, rng.choice([0, 1, 1, 1, None])) for a, b in rows] + [(100 + k, 101 + k, 1) for k in range(30)] + [(100 + k, 102 + k, 1) for k in range(29)] + [(130, 0, 0)]
    wrong = {(a, b): None if g is None else g == 0 for a, b, g in rows}
    dead = set()
    while True:
        states = {}
        for (a, b), w in wrong.items():
            states.setdefault(a, []).append(True if b in dead else w)
        new = {a for a, v in states.items() if any(v) and all(x is not False for x in v)}
        if new == dead:
            break
        dead = new
    kinds = []
    real = labels.written
    monkeypatch.setattr(labels, "written", lambda df, kind, *a: kinds.append(kind) or real(df, kind, *a))
    found = labels.trap_edges(spark.createDataFrame(rows, "src long, dst long, gt_bin int"))
    assert {(r["src"], r["dst"]): r["trap"] for r in found.collect()} == {k: int(k[1] in dead) for k in wrong}
    assert kinds.count("traps") <= 2 and len(dead) > 30


def test_an_edge_is_written_once_a_layer(spark, monkeypatch):
    """Three layers against numpy, in tiny batches and sums, with a node of many edges and nodes of none; of each layer's tables one
    holds the edges' vectors."""
    tables = []
    monkeypatch.setattr(score, "written", lambda df, kind: tables.append(df.columns) or written(df, kind))
    monkeypatch.setattr(vectors, "HELD", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(5)
        n, pairs = 14, sorted({(0, int(b)) for b in range(1, 12)} | {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b})
        h, g = rng.normal(size=(n, SIZE)), rng.normal(size=(len(pairs), SIZE))
        of_nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "node long, h array<double>").repartition(3)
        of_edges = spark.createDataFrame([(a, b, v.tolist()) for (a, b), v in zip(pairs, g, strict=True)], "src long, dst long, e array<double>").repartition(3)
        new, new_e = score.gated_network(of_nodes, of_edges, [WEIGHTS] * 3, SIZE)
        w, (src, dst) = {k: np.array(v) for k, v in WEIGHTS.items()}, np.array(pairs).T
        for _ in range(3):
            raw = h[src] @ w["B1"].T + h[dst] @ w["B2"].T + g @ w["B3"].T
            gate, out = 1 / (1 + np.exp(-raw)), h @ w["A1"].T
            for to, v in ((dst, (h @ w["A2"].T)[src]), (src, (h @ w["A3"].T)[dst])):
                up, low = np.zeros((n, SIZE)), np.full((n, SIZE), 1e-6)
                np.add.at(up, to, gate * v)
                np.add.at(low, to, gate)
                out += up / low
            h, g = h + np.maximum(out, 0), g + np.maximum(raw, 0)
        assert np.allclose([r["h"] for r in new.orderBy("node").collect()], h)
        got = {(r["src"], r["dst"]): r["e"] for r in new_e.collect()}
        assert len(got) == len(pairs) and np.allclose([got[p] for p in pairs], g)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum("e" in columns for columns in tables) == 3
    assert score.gated_network(of_nodes, of_edges.limit(0), [WEIGHTS] * 2, SIZE)[0].count() == n


def test_the_graph_of_searches_is_not_shuffled_by_rounds(spark):
    """What a round looks up in the graph shuffles its states only; buckets give the rows that were put into them, and can be forgotten."""
    edges = spark.createDataFrame([(0, h, a, b, 10, 0.5) for h in "pm" for a, b in [(0, 2), (2, 4), (2, 6), (4, 8), (6, 8), (8, 10)]], "component int, hap string, src long, dst long, prefix_length long, gain double")
    graph = decode.search_graph(edges)
    at = [*decode.GROUP, "backward", "node"]
    for table, keys in ((graph.exits, at), (graph.chains, [*decode.GROUP, "head"]), (graph.stops, [*decode.GROUP, "head", "goal"])):
        states = spark.createDataFrame(table.select(*keys).limit(3).collect(), table.select(*keys).schema).repartition(3)
        met = states.hint("merge").join(table, keys)
        assert met.count() >= 3 and plan(met).count("Exchange hashpartitioning") == 1
    assert {(r["node"], r["next"]) for r in graph.exits.where("not backward").collect()} == {(2, 4), (2, 6), (4, 8), (6, 8)}
    kept = bucketed(spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "v long, u long"), "test-buckets", ["v"], distinct=True)
    assert sorted(map(tuple, kept.collect())) == [(1, 2), (3, 4)]
    forget(kept)
    assert not spark.catalog.tableExists(kept._table)


def test_components_write_all_nodes_once(spark, monkeypatch):
    """Random edges, a line and a node of many edges, against plain Python; only the end writes a label for each node."""
    kinds = []
    monkeypatch.setattr(components, "written", lambda df, kind: kinds.append(kind) or written(df, kind))
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(400, b) for b in range(390, 440)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = components.wcc(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, top(x)) for x in up} and len(got) == len(up)
    assert kinds.count("wcc-labels") == 1


def moved(spark) -> int:
    """Bytes that the session's stages have shuffled and written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_places_are_not_shuffled_by_themselves(spark):
    """every k-mer of every read was a row of the shuffle, twice, about 48 bytes a place."""
    letters = walk_queries._dna(spark, str(DATA)).agg(F.sum(F.length("seq"))).first()[0]
    before = moved(spark)
    assert QUERIES["kmer_hits"](spark, str(DATA)).count() > 0
    assert moved(spark) - before < 8 * letters


def test_bins_of_kmers_in_parts(monkeypatch):
    """A bin in several looks, a sequence in stretches, and hashes that fall together give the same counts."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGTNRYK") for _ in range(40)) for _ in range(5)]
    texts += [texts[0][5:38] * 2, texts[1][::-1].translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT)), "A" * 50]
    k, names = 11, ["p", "m", None, "p", "m", "m", "p", None]
    turn = str.maketrans(IUPAC, IUPAC_COMPLEMENT)
    canon = [[min(w, w[::-1].translate(turn)) for w in (s[i : i + k] for i in range(len(s) - k + 1))] for s in texts]
    want = {(str(i), p): n for i in range(1, 8) for p in "pm" if (n := sum(w in {x for c, q in zip(canon, names, strict=True) if q == p for x in c} for w in canon[i]))}
    ids = metrics.pa.array([None, *map(str, range(1, 8))])
    for letters, together, hashed in ((4_000_000, 1_000_000, None), (30, 3, None), (30, 1_000_000, 7)):
        monkeypatch.setattr(metrics, "LETTERS", letters)
        monkeypatch.setattr(metrics, "TOGETHER", together)
        if hashed:
            monkeypatch.setattr(metrics, "_hash", lambda words: words[0] % np.uint64(hashed))  # noqa: B023
        bins = {}
        for piece in metrics._pieces(*metrics._letters(metrics.pa.chunked_array([texts])), k, 6):
            for row in metrics._rows_of_bins(*piece, ids, metrics.pa.array(names)):
                for b, blob in zip(row.column(0).to_pylist(), row.column(1), strict=True):
                    bins.setdefault(b, []).append(metrics._unblob(blob.as_buffer()))
        found = metrics._summed([metrics._hits(group, k) for group in bins.values()]).to_pylist()
        assert {(r["read_id"], r["parent"]): r["hits"] for r in found} == want


def test_layers_in_buckets(spark, monkeypatch):
    """two layers against numpy where most edges lie between buckets, in tiny pieces; edges without a node at an end, loops, edges
    that are there twice and nodes without edges."""
    for name, value in (("BLOCK", 1), ("TOGETHER", 9)):
        monkeypatch.setattr(score, name, value)
    rng = np.random.default_rng(6)
    n, pairs = 40, [(int(a), int(b)) for a, b in rng.integers(0, 36, (90, 2))] + [(3, 3), (5, 6), (5, 6)] + [(0, b) for b in range(1, 30)]
    h, g = rng.normal(size=(n, SIZE)), rng.normal(size=(len(pairs), SIZE))
    of_nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "node long, h array<double>").repartition(3)
    rows = [(a, b, v.tolist()) for (a, b), v in zip(pairs, g, strict=True)]
    of_edges = spark.createDataFrame([*rows, (2, 77, [1.0] * SIZE), (-5, 3, [1.0] * SIZE)], "src long, dst long, e array<double>").repartition(3)
    new, new_e = score.gated_network(of_nodes, of_edges, [WEIGHTS] * 2, SIZE)
    w, (src, dst) = {k: np.array(v) for k, v in WEIGHTS.items()}, np.array(pairs).T
    for _ in range(2):
        raw = h[src] @ w["B1"].T + h[dst] @ w["B2"].T + g @ w["B3"].T
        gate, out = 1 / (1 + np.exp(-raw)), h @ w["A1"].T
        for to, v in ((dst, (h @ w["A2"].T)[src]), (src, (h @ w["A3"].T)[dst])):
            up, low = np.zeros((n, SIZE)), np.full((n, SIZE), 1e-6)
            np.add.at(up, to, gate * v)
            np.add.at(low, to, gate)
            out += up / low
        h, g = h + np.maximum(out, 0), g + np.maximum(raw, 0)
    got = new.orderBy("node").collect()
    assert [r["node"] for r in got] == list(range(n)) and np.allclose([r["h"] for r in got], h)
    assert sorted((r["src"], r["dst"], *np.round(r["e"], 6)) for r in new_e.collect()) == sorted((a, b, *np.round(v, 6)) for (a, b), v in zip(pairs, g, strict=True))


@pytest.mark.parametrize(("name", "most"), [("gated_network", 420), ("gated_conv", 200), ("gated_conv_edges", 200)])
def test_layers_move_few_bytes(spark, name, most):
    """bytes shuffled and written for an edge, the edges' own derivation included."""
    data = str(DATA.parent / "sf0.01")
    edges = QUERIES["edges_fixture"](spark, data).count()
    before = moved(spark)
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < most * edges
