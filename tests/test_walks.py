"""Decoding by joins against plain Python, component by component."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import slow_walks
from pairstrand.operators import decode
from pairstrand.plans import walk_queries
from pairstrand.plans.catalog import QUERIES


def graph(spark, seed, n=60, turn=0.0):
    """Overlapping reads of two strands, with some wrong edges; ``turn`` is the share of edges that change strands."""
    rng = random.Random(seed)
    edges = {}
    for a in range(n):
        for step in (1, 2, 3, rng.randint(4, 9)):
            b = a + step
            if b < n and rng.random() < 0.75 and a % 20 != 19:
                src, dst = 2 * a, 2 * b + (rng.random() < turn)
                row = (rng.randint(100, 900), rng.randint(100, 900), round(rng.random() / 400, 5), 0.1)
                edges.setdefault((src, dst), row)
                edges.setdefault((dst ^ 1, src ^ 1), row)
    nodes = [(x, 1000 + 10 * (x // 2), rng.random() / 2000, rng.random() / 2000) for x in range(2 * n)]
    e = spark.createDataFrame([(*k, *v) for k, v in edges.items()], "src long, dst long, overlap_length long, prefix_length long, score double, to_cut double")
    return spark.createDataFrame(nodes, "node long, read_length long, kmer_count_p double, kmer_count_m double"), e


def components(n, e, s, haps):
    rows = decode.scored_components(n, e, s, haps).toPandas()
    return {k: slow_walks.Component(g) for k, g in rows.groupby(["component", "hap"])}


@pytest.mark.parametrize(("seed", "turn", "width"), [(1, 0.0, 5), (2, 0.1, 2), (3, 0.0, 1)])
def test_beam_walks(spark, seed, turn, width):
    n, e = graph(spark, seed, turn=turn)
    s = decode.Strategy(min_component_size=3, beam_width=width)
    want = {}
    for (c, hap), g in components(n, e, s, ["p", "m"]).items():
        path, _, total, length = slow_walks.beam(g, min(g.length), frozenset(), width)
        want[c, hap] = (len(path), length, round(total, 9))
    got = {(r["component"], r["hap"]): (r["n_nodes"], r["length"], round(r["gain"], 9)) for r in decode.beam_walks(n, e, s, ["p", "m"]).collect()}
    assert got == want and len(got) >= 2


@pytest.mark.parametrize(
    ("seed", "turn", "more"),
    [(4, 0.0, {"visited": "1-hop"}), (5, 0.1, {"visited": "shared_neighbors", "sample_by_score": True}), (6, 0.0, {"visited": "2-hop", "beam_width": 1, "beam_intermediate": False})],
)
def test_get_walks(spark, seed, turn, more):
    n, e = graph(spark, seed, 16, turn)
    s = decode.Strategy(min_component_size=3, min_walk_length=1500, min_path_length=5, sample_size=2, **more)
    want = {}
    for (c, hap), g in components(n, e, s, ["p", "m"]).items():
        for k, path in enumerate(slow_walks.find_paths(g, s)):
            want[hap, f"{c}.{k}"] = path
    rows = decode.get_walks(n, e, s, ["p", "m"]).groupBy("hap", "walk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("path")).collect()
    assert {(r["hap"], r["walk_id"]): r["path"] for r in rows} == want and len(want) >= 2


def test_backward_from_a_start_without_its_twin(spark):
    """A component that isn't its own mirror: what lies before the start is searched against the edges."""
    rows = [(2 * i, 2 * i + 2, 1000, 9000, 0.0, 0.0) for i in range(12)]
    rows += [(b ^ 1, a ^ 1, o, p, x, y) for a, b, o, p, x, y in rows]
    e = spark.createDataFrame(rows, "src long, dst long, overlap_length long, prefix_length long, score double, to_cut double")
    n = spark.createDataFrame([(i, 10000) for i in range(26)], "node long, read_length long")
    own = decode.scored_components(n, e, decode.Strategy(min_component_size=3))
    starts = own.where("src = 10").select("component", "hap", F.lit(1).alias("search"), "src", "dst")
    row = decode.walks_through(starts, own, decode.Strategy()).first()
    assert row["path"] == list(range(0, 25, 2)) and row["length"] == 12 * 9000 + 10000


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize(("name", "width"), [("beam_walk", 5), ("greedy_walk", 1)])
def test_walk_queries(spark, name, width):
    n, e = walk_queries._decode_input(spark, str(DATA))
    want = {}
    for (c, hap), g in components(n, e, decode.Strategy(min_component_size=3, c_t=1.0, c_b=1.0), ["p", "m"]).items():
        path, _, total, length = slow_walks.beam(g, min(g.length), frozenset(), width)
        want[c, hap] = (len(path), length, round(total, 9))
    got = {(r["component"], r["hap"]): (r["n_nodes"], r["length"], round(r["gain"], 9)) for r in QUERIES[name](spark, str(DATA)).collect()}
    assert got == want and got


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_find_paths_query(spark):
    n, e = walk_queries._decode_input(spark, str(DATA))
    s = walk_queries.PEELING
    want = {(hap, f"{c}.{k}", i, x) for (c, hap), g in components(n, e, s, ["p", "m"]).items() for k, path in enumerate(slow_walks.find_paths(g, s)) for i, x in enumerate(path)}
    assert {(r["hap"], r["walk_id"], r["pos"], r["node"]) for r in QUERIES["find_paths"](spark, str(DATA)).collect()} == want and want


def test_strategies_from_yaml(tmp_path):
    (tmp_path / "s.yml").write_text("beam:\n  c_t: 0.4\n  mark_as_visited: 1-hop\n  unknown: 3\ngraphic:\n  beam_width: 7\n  thr_graphic: 0.1\n")
    got = decode.read_strategies(str(tmp_path / "s.yml"))
    assert (got["beam"].c_t, got["beam"].visited, got["beam"].graphic) == (0.4, "1-hop", False)
    assert (got["graphic"].beam_width, got["graphic"].graphic_threshold, got["graphic"].graphic) == (7, 0.1, True)


def chain_graph(seed, turn):
    """Stretches of nodes without branches, some joined at their ends and some inside, both strands; gains of multiples of 2^-20."""
    rng = random.Random(seed)
    edges, first = {}, []

    def add(a, b):
        gain = rng.randint(-200_000, 1 << 20) / (1 << 20)
        edges.setdefault((a, b), (gain, rng.randint(1, 90)))
        edges.setdefault((b ^ 1, a ^ 1), (gain, rng.randint(1, 90)))

    n = 0
    for _ in range(9):
        size = rng.randint(1, 14)
        for i in range(n, n + size - 1):
            add(2 * i, 2 * (i + 1) + (rng.random() < turn))
        first.append((n, size))
        n += size
    for _ in range(14):
        (a, m), (b, _) = rng.choice(first), rng.choice(first)
        at = a + (m - 1 if rng.random() < 0.7 else rng.randrange(m))
        if a != b:
            add(2 * at, 2 * b + (rng.random() < turn))
    for _ in range(4):  # one strand only, so that mirrors of chains branch elsewhere
        a, b = rng.randrange(2 * n), rng.randrange(2 * n)
        if a != b:
            edges.setdefault((a, b), (rng.randint(0, 1 << 20) / (1 << 20), 5))
    return n, [(0, hap, a, b, p, 100, 100, g + (hap == "m") * 0.25) for (a, b), (g, p) in edges.items() for hap in "pm"]


@pytest.mark.parametrize(("seed", "turn", "width", "intermediate"), [(1, 0.0, 1, True), (2, 0.1, 3, True), (3, 0.2, 2, False), (4, 0.05, 5, True)])
def test_search_on_chains(spark, seed, turn, width, intermediate):
    """Every search, forward or backward and with nodes that it may not visit, walks as one that goes edge by edge."""
    import pandas as pd

    n, rows = chain_graph(seed, turn)
    names = "component int, hap string, src long, dst long, prefix_length long, src_length long, dst_length long, gain double"
    edges = spark.createDataFrame(rows, names)
    rng, starts, seen, want = random.Random(seed), [], [], {}
    groups = {h: slow_walks.Component(pd.DataFrame([r for r in rows if r[1] == h], columns=[c.split()[0] for c in names.split(", ")])) for h in "pm"}
    for k in range(60):
        hap, backward, node = rng.choice("pm"), rng.random() < 0.4, rng.randrange(2 * n)
        closed = {rng.randrange(2 * n) for _ in range(rng.choice([0, 2, 8]))}
        starts.append((0, hap, k, backward, node))
        seen += [(0, hap, k, x) for x in closed]
        path, visited, total, length = slow_walks.beam(groups[hap], node, frozenset(closed), width, intermediate, backward)
        want[k] = (path, total, length, visited & groups[hap].length.keys())
    graph = decode.search_graph(edges)
    closed = spark.createDataFrame(seen, "component int, hap string, search int, node long")
    walks, visited = decode.beam_search(spark.createDataFrame(starts, "component int, hap string, search int, backward boolean, node long"), graph, width, closed, intermediate)
    found = {}
    for r in visited.collect():
        found.setdefault(r["search"], set()).add(r["node"])
    got = {r["search"]: (r["path"], r["total"], r["length"], found[r["search"]] & groups[starts[r["search"]][1]].length.keys()) for r in walks.collect()}
    assert got == want and max(len(w[0]) for w in want.values()) > 10


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """20,000 nodes without a branch: a few rounds, and written bytes that grow with the nodes."""
    made = []
    folder = decode.new_folder
    monkeypatch.setattr(decode, "new_folder", lambda s, kind: made.append(folder(s, kind)) or made[-1])
    edges = spark.range(20_000).select(F.lit(0).alias("component"), F.lit("h").alias("hap"), (2 * F.col("id")).alias("src"), (2 * F.col("id") + 2).alias("dst"), F.lit(10).cast("long").alias("prefix_length"), F.lit(1.0).alias("gain"))
    starts = spark.createDataFrame([(0, "h", 1, False, 100), (0, "h", 2, True, 39_000)], "component int, hap string, search int, backward boolean, node long")
    none = spark.createDataFrame([], "component int, hap string, search int, node long")
    walks, _ = decode.beam_search(starts, decode.search_graph(edges), 5, none)
    got = {r["search"]: r for r in walks.collect()}
    assert got[1]["path"] == list(range(100, 40_001, 2)) and got[2]["path"] == list(range(39_000, -1, -2))
    assert got[1]["length"] == 10 * (20_000 - 50) and got[1]["total"] == 20_000 - 50
    rounds = [p for p in Path(made[0].removeprefix("file:")).glob("states/n=*")]
    assert len(rounds) <= 5
