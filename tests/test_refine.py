"""Refiners against plain Python: lightest ways with weights of any sign, choke points, ends grown anew."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import slow_walks
from pairstrand.operators import refine


def random_graph(seed, n, m, back):
    """Edges mostly from smaller to larger nodes; ``back`` is the share of those that go the other way."""
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = sorted(rng.sample(range(n), 2))
        if b - a < 8:
            edges.add((b, a) if rng.random() < back else (a, b))
    return rng, sorted(edges)


def bellman(edges, start, n):
    """Least (cost, hops) of every node from a start, or None where a cycle of negative weight is reached."""
    best = {start: (0, 0)}
    for turn in range(n + 1):
        changed = False
        for a, b, w in edges:
            if a in best:
                c = (best[a][0] + w, best[a][1] + 1)
                if b not in best or c < best[b]:
                    best[b], changed = c, True
        if not changed:
            return best
    return None


@pytest.mark.parametrize(("seed", "low", "back"), [(1, 0, 0.2), (2, -3, 0.0), (25, -4, 0.04)])
def test_lightest_ways(spark, seed, low, back):
    rng, pairs = random_graph(seed, 60, 150, back)
    edges = [(a, b, rng.randint(low, 9)) for a, b in pairs]
    weight = {(a, b): w for a, b, w in edges}
    ways = [(k, rng.randrange(60), rng.randrange(60)) for k in range(40)]
    got = {r["k"]: (r["cost"], r["path"]) for r in refine.lightest_ways(spark.createDataFrame(edges, "src long, dst long, weight long"), spark.createDataFrame(ways, "k int, start long, end long"), ["k"]).collect()}
    none = 0
    for k, start, end in ways:
        best = bellman(edges, start, 60)
        none += best is None
        if best is None or end not in best:
            assert k not in got
            continue
        cost, path = got[k]
        assert (cost, len(path) - 1) == best[end] and path[0] == start and path[-1] == end
        assert sum(weight[e] for e in zip(path[:-1], path[1:], strict=True)) == cost
    assert len(got) > 5 and (none > 0) == (seed == 25)


def test_long_ways_are_traced_in_few_rounds(spark):
    """A way of 3,000 nodes is put together by following pointers to pointers."""
    pointers = spark.range(1, 3000).select(F.lit(1).alias("k"), F.col("id").alias("node"), (F.col("id") - 1).alias("up"))
    got = refine.traces(pointers, spark.createDataFrame([(1, 2999)], "k int, node long"), ["k"]).collect()
    assert sorted((r["back"], r["node"]) for r in got) == [(i, 2999 - i) for i in range(3000)]


def test_bellman_walks(spark):
    """Right nodes draw the walk on; a cycle of them leaves a walk as it is."""
    nodes = spark.createDataFrame([(x, -1 if x in (3, 14) else 1) for x in range(20)], "node long, y int")
    edges = spark.createDataFrame([(0, 3), (3, 5), (0, 1), (1, 2), (2, 5), (0, 5), (10, 14), (14, 15), (14, 11), (11, 12), (12, 11), (12, 15)], "src long, dst long")
    walks = [("m", 1, 0, 0), ("m", 1, 1, 3), ("m", 1, 2, 5), ("m", 2, 0, 10), ("m", 2, 1, 14), ("m", 2, 2, 15), ("m", 3, 0, 0), ("m", 3, 1, 5)]
    got = refine.bellman_walks(spark.createDataFrame(walks, "hap string, walk_id long, pos int, node long"), edges, nodes, "y").collect()
    paths = {}
    for r in sorted(got):
        paths.setdefault(r["walk_id"], []).append(r["node"])
    assert paths == {1: [0, 1, 2, 5], 2: [10, 14, 15], 3: [0, 5]}


@pytest.mark.parametrize(("seed", "back"), [(1, 0.0), (2, 0.0), (3, 0.03)])
def test_choke_points(spark, seed, back):
    rng, edges = random_graph(seed, 50, 75, back)
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(start, without=None):
        seen, todo = {start}, [start]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen and y != without:
                    seen.add(y)
                    todo.append(y)
        return seen

    ways = [(k, *sorted(rng.sample(range(50), 2))) for k in range(40)] + [(99, 7, 7)]
    df, given = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(ways, "k int, start long, end long")
    inner, chokes = {}, {}
    for r in refine.between(df, given, ["k"]).collect():
        inner.setdefault(r["k"], set()).add((r["src"], r["dst"]))
    for r in refine.choke_points(df, given, ["k"]).orderBy("k", "place").collect():
        chokes.setdefault(r["k"], []).append(r["node"])
    several = 0
    for k, start, end in ways:
        ahead = reach(start)
        want = {(a, b) for a, b in edges if a in ahead and end in reach(b)}
        assert inner.get(k, set()) == want
        on = {x for e in want for x in e}
        cycle = any(a in reach(b) for a, b in want)
        if cycle or (end not in ahead):
            assert k not in chokes
            continue
        must = {x for x in on if x not in (start, end) and end not in reach(start, x)} | {start, end}
        assert set(chokes[k]) == must and chokes[k][0] == start and chokes[k][-1] == end
        assert all(b in reach(a) for a, b in zip(chokes[k][:-1], chokes[k][1:], strict=True))
        several += len(must) > 2
    assert several > 1


def test_extend_ends(spark):
    """Every walk's ends grow as a greedy search by hand lets them."""
    rng = random.Random(7)
    edges = {}
    for a in range(80):
        for b in rng.sample(range(a + 1, a + 9), 3):
            if b < 80:
                edges.setdefault((2 * a, 2 * b), round(rng.random(), 3))
                edges.setdefault((2 * b + 1, 2 * a + 1), round(rng.random(), 3))
    label = {h: {x: rng.choice([-1, 0, 1, 1]) for x in range(160)} for h in "pm"}
    walks = {}
    for k in range(12):
        hap, at, path = rng.choice("pm"), 2 * rng.randrange(10, 50), []
        for _ in range(8):
            path.append(at)
            nxt = [b for a, b in edges if a == at]
            if not nxt:
                break
            at = rng.choice(sorted(nxt))
        walks[hap, k] = path
    groups = {h: slow_walks.Component(pd.DataFrame([(a, b, 0, 0, 0, -round(s * 2**20) / 2**20) for (a, b), s in edges.items()], columns=["src", "dst", "prefix_length", "src_length", "dst_length", "gain"])) for h in "pm"}
    want = {}
    for (hap, k), path in walks.items():
        good = [i for i, x in enumerate(path) if label[hap][x] != -1]
        if not good:
            continue
        kept = path[good[0] : good[-1] + 1]
        closed = frozenset(x for x in label[hap] if label[hap][x] == -1) | {y for x in kept for y in (x, x ^ 1)}
        ahead, seen, _, _ = slow_walks.beam(groups[hap], kept[-1], closed, 1, False)
        behind = slow_walks.beam(groups[hap], kept[0], seen, 1, False, backward=True)[0]
        want[hap, k] = behind[:0:-1] + kept + ahead[1:]
    rows = [(h, k, i, x) for (h, k), p in walks.items() for i, x in enumerate(p)]
    nodes = spark.createDataFrame([(x, label["p"][x], label["m"][x]) for x in range(160)], "node long, yak_p int, yak_m int")
    e = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "src long, dst long, score double")
    got = {}
    for r in refine.extend_ends(spark.createDataFrame(rows, "hap string, walk_id long, pos int, node long"), e, nodes, {"p": "yak_p", "m": "yak_m"}).orderBy("pos").collect():
        got.setdefault((r["hap"], r["walk_id"]), []).append(r["node"])
    assert got == want and any(len(want[w]) > len(walks[w]) for w in want)
