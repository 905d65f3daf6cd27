"""Detours against plain Python."""

import random

import pytest

from pairstrand.operators import explore


def setting(seed, n=70):
    """Two strands of overlapping reads, labels, and walks along them."""
    rng = random.Random(seed)
    edges = {}
    for a in range(n):
        for b in rng.sample(range(a + 1, a + 7), 3):
            if b < n:
                edges[2 * a, 2 * b] = (round(rng.random(), 3), 100 * (b - a) + rng.randint(-4, 4))
                if rng.random() < 0.9:
                    edges[2 * b + 1, 2 * a + 1] = (round(rng.random(), 3), 100 * (b - a))
    label = {h: {x: rng.choice([-1, 0, 1, 1, 1]) for x in range(2 * n)} for h in "pm"}
    walks = {}
    for k in range(6):
        hap, at, path = rng.choice("pm"), 2 * rng.randrange(8), []
        while len(path) < 18:
            path.append(at)
            nxt = sorted(b for a, b in edges if a == at)
            if not nxt:
                break
            at = rng.choice(nxt)
        walks[hap, k] = path
    return edges, label, walks


def plain_detours(path, edges, label, margin=0.6, wrong=0.6, ambiguous=0.05, tolerance=0.05):
    length = lambda a, b: edges[a, b][1]
    bad = lambda a, b: edges[a, b][1] if label[b] == -1 else 0
    steps = list(zip(path[:-1], path[1:], strict=True))
    where = {x: k for k, x in enumerate(path)}
    out = []
    for i, (here, follows) in enumerate(steps):
        room = sum(length(*s) for s in steps[i:]) * (1 + tolerance)
        may = lambda y: (y ^ 1) not in where and (y not in where or where[y] > i)  # noqa: E731, B023
        for first in sorted(b for a, b in edges if a == here and b != follows):
            if not may(first) or abs(edges[here, first][0] - edges[here, follows][0]) > margin or length(here, first) > room:
                continue
            inner, total, worse, at = [], length(here, first), bad(here, first), first
            while at is not None and at not in where:
                inner.append(at)
                options = [(edges[at, y][0] + {-1: wrong, 0: ambiguous}.get(label[y], 0.0), y) for a, y in edges if a == at and may(y) and y not in inner and y ^ 1 not in inner and total + length(at, y) <= room]
                nxt = min(options)[1] if options else None
                if nxt is not None:
                    total, worse = total + length(at, nxt), worse + bad(at, nxt)
                at = nxt
            if at is None:
                continue
            j = where[at]
            stretch, held = sum(length(*s) for s in steps[i:j]), sum(bad(*s) for s in steps[i:j])
            if abs(total - stretch) <= tolerance * stretch and worse < held:
                out.append((held - worse, -i, -first, j, inner))
    return out


def plain_explored(path, edges, label):
    while True:
        found = plain_detours(path, edges, label)
        keys = lambda d: {("place", k) for k in range(-d[1], d[3])} | {("node", x >> 1) for x in d[4]}
        chosen = [d for d in found if not any(e[:3] > d[:3] and keys(e) & keys(d) for e in found)]
        if not chosen:
            return path
        out = []
        for k, x in enumerate(path):
            if not any(-d[1] < k < d[3] for d in chosen):
                out.append(x)
            for d in chosen:
                if k == -d[1]:
                    out += d[4]
        path = out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_explored(spark, seed):
    edges, label, walks = setting(seed)
    rows = [(h, k, i, x) for (h, k), p in walks.items() for i, x in enumerate(p)]
    w = spark.createDataFrame(rows, "hap string, walk_id long, pos int, node long")
    e = spark.createDataFrame([(a, b, s, n) for (a, b), (s, n) in edges.items()], "src long, dst long, score double, prefix_length long")
    n = spark.createDataFrame([(x, label["p"][x], label["m"][x]) for x in label["p"]], "node long, yak_p int, yak_m int")
    got = {}
    for r in explore.explored(w, e, n, {"p": "yak_p", "m": "yak_m"}).orderBy("pos").collect():
        got.setdefault((r["hap"], r["walk_id"]), []).append(r["node"])
    want = {k: plain_explored(p, edges, label[k[0]]) for k, p in walks.items()}
    assert got == want and any(want[k] != walks[k] for k in walks)
    for (hap, k), path in got.items():
        wrong = lambda p: sum(edges[s][1] for s in zip(p[:-1], p[1:], strict=True) if label[hap][s[1]] == -1)  # noqa: E731, B023
        assert wrong(path) <= wrong(walks[hap, k]) and len({x >> 1 for x in path}) == len(path)


def test_nothing_to_explore(spark):
    edges = spark.createDataFrame([(0, 2, 0.1, 10), (2, 4, 0.1, 10)], "src long, dst long, score double, prefix_length long")
    nodes = spark.createDataFrame([(x, -1) for x in (0, 2, 4)], "node long, yak_m int")
    walk = spark.createDataFrame([("m", 1, 5, 0), ("m", 1, 6, 2), ("m", 1, 9, 4)], "hap string, walk_id long, pos int, node long")
    assert sorted(tuple(r) for r in explore.explored(walk, edges, nodes, {"m": "yak_m"}).collect()) == [("m", 1, 0, 0), ("m", 1, 1, 2), ("m", 1, 2, 4)]
    assert explore.explored(walk.limit(0), edges, nodes, {"m": "yak_m"}).count() == 0
