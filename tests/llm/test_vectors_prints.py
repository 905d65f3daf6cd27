"""Hard negatives, clusters and fingerprints against brute force and on odd inputs."""

import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairstrand.llm import clusters, fingerprints, hard_negatives
from pairstrand.llm.textarrays import mix

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, block int, bucket long, cluster int, norm2 double, anchor string"
NAN, INF = float("nan"), float("inf")


def odd_vectors(d, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d) * rng.choice([0.1, 1, 3])], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(60)]  # equal vectors
    rows += [rows[8], rows[9], (20, rows[11][1], 3)]  # repeated rows, and an id with two vectors
    rows += [(None, rows[3][1], 1), (900, None, 1), (901, rows[4][1], None), (902, [], 1), (903, [1.0], 1), (904, [NAN] + [0.0] * (d - 1), 1), (905, [INF] + [0.0] * (d - 1), 2), (906, [None] + [1.0] * (d - 1), 2), (907, [0.0] * d, 2), (-100, rows[5][1], 0), (1000, [1e30] + [0.0] * (d - 1), 2)]
    return [(i, v, lab, 5, "x", 1, 1, 1, 0.5, "a") for i, v, lab in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(odd_vectors(8), VECTORS).repartition(3)


def whole(v, scale, bound):
    return [max(-bound, min(bound, int(np.floor(max(-1e18, min(1e18, scale * float(x))))))) for x in v]


def brute_mine(rows, d, anchor, label, positives=5, negatives=10):
    bound = int(np.sqrt((2**63 - 1) // (100 * d)))
    while bound * bound > (2**63 - 1) // (100 * d):
        bound -= 1
    best = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or len(v) != d or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label(i, lab), whole(v, 256, bound))
        best[i] = min(best.get(i, row), row)
    out = set()
    for a in best:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(best[a][1], v, strict=True)), i, lab) for i, (lab, v) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == best[a][0]][:positives]:
            fit = [(t, i) for t, i, lab in scored if lab != best[a][0] and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)}
    return out


def test_hard_negatives(spark, vectors, monkeypatch):
    for name, size in (("BUCKET", 16), ("SHARD", 2), ("BLOCK", 3)):
        monkeypatch.setattr(hard_negatives, name, size)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hard_negatives.mine(vectors, F.col("id") % 20 == 0, label).collect()]
    want = brute_mine([r[:3] for r in odd_vectors(8)], 8, lambda i: i % 20 == 0, lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert {r[0] for r in want} >= {0, 20, -100}


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("id") % 20 == 0, F.col("label")).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 5, "x", 1, 1, 1, 0.5, "a")], VECTORS)
    assert hard_negatives.mine(one, F.col("id") % 20 == 0, F.col("label")).collect() == []


def test_pruning_skips_buckets_and_keeps_ties():
    """Only a bucket that can matter is multiplied, and a tie at the bound still counts."""
    import pandas as pd

    def bucket(k, rows):
        v = np.array([r[1] for r in rows], "<i8")
        return {"bucket": k, "top": float(np.sqrt((v * v).sum(1).max())), "ids": np.array([r[0] for r in rows], "<i8").tobytes(), "labels": np.zeros(len(rows), "<i8").tobytes(), "v": v.tobytes()}

    anchors = pd.DataFrame({"id": [0], "label": [0], "v": [[2, 0]], "norm2": [4], "windows": [[{"slot": 1, "score": None, "kth": None}]]})
    some = pd.DataFrame([bucket(0, [(5, [9, 0])]), bucket(1, [(4, [9, 0])]), bucket(2, [(3, [8, 0])])])
    calls, product = [], hard_negatives.exact_products
    hard_negatives.exact_products = lambda x, y: calls.append(len(y)) or product(x, y)
    try:
        got = hard_negatives.search_buckets(some, anchors, 1, True, 30, 90)
    finally:
        hard_negatives.exact_products = product
    assert got.values.tolist() == [[0, 1, 4, 18]] and len(calls) == 2


def brute_clusters(rows, d, k, rounds):
    own = [(i, whole(v, 64, clusters.LIMIT)) for i, v, _ in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in own]
        c = [[sum(col) // len(col) for col in zip(*(v for (_, v), a in zip(own, at, strict=True) if a == j), strict=True)] if j in at else m for j, m in enumerate(c)]
    found = [(i, *reversed(near(v))) for i, v in own]
    sums = {j: sum(x for _, b, x in found if b == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((repr(i), j, x, sums[j], sum(sums.values()), sha[j]) for i, j, x in found)


@pytest.mark.parametrize(("k", "n"), [(16, 400), (5, 400), (1, 30), (40, 12)])
def test_clusters(spark, k, n):
    rows = odd_vectors(8, n) if n == 400 else odd_vectors(8, n, 3)[:n]
    rows = [r for r in rows if r[0] != 1000]
    got = clusters.clusters(spark.createDataFrame(rows, VECTORS), k=k, dimension=8).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_clusters([r[:3] for r in rows], 8, k, 3)


def test_clusters_of_odd_tables(spark):
    assert clusters.clusters(spark.createDataFrame([], VECTORS)).collect() == []
    huge = spark.createDataFrame([(i, [1e38 * (i % 2)] * 64, 1, *[None] * 7) for i in range(40)], VECTORS)
    rows = clusters.clusters(huge, k=1).collect()
    assert len(rows) == 40 and all(r["inertia"] is None or r["inertia"] > 0 for r in rows)


def test_exponion_looks_at_few_centroids_and_errs_nowhere():
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (64, 6))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-6, 7, (4000, 6))
    own, best, lower = clusters.Exponion(centres).first(x)
    state = own, np.sqrt(best.astype(float)), lower
    for step in range(4):
        before, centres = centres, centres + rng.integers(-3, 4, centres.shape)
        if step == 2:
            centres[5] = centres[9]  # equal centroids: the smaller number wins
        *state, looked = clusters.Exponion(centres, before).again(x, *state)
        d = clusters.squared(x, centres)
        assert (state[0] == d.argmin(1)).all()
        assert (state[1] >= np.sqrt(d.min(1)) * (1 - 1e-9)).all() and (state[2] <= np.sort(np.sqrt(d), axis=1)[:, 1] * (1 + 1e-9)).all()
        assert looked < 0.2 * d.size


# -- fingerprints ----------------------------------------------------------------------------------------------------


def plain_hash(text, base):
    h = 0
    for c in text:
        h = (h * base + ord(c) + 1) % fingerprints.PRIME
    return h


def plain_print(text):
    n, span = len(text), min(fingerprints.SPAN, max(len(text), 1))
    least = {}
    for i in range(n - span + 1):
        a, b = (plain_hash(text[i : i + span], base) for base in fingerprints.BASES)
        g = int(mix(np.array([(a << 31) ^ b], np.uint64))[0])
        r, v = g >> 58, (g << 6) & (2**64 - 1)
        least[r] = min(least.get(r, v), v)
    registers = [int(mix(np.array([least[r]], np.uint64))[0]) % 65535 + 1 if r in least else 0 for r in range(64)]
    places = [p for p in [*range(1, 8), *(int(8 * 2 ** (k / 4)) for k in range(100))] if p <= n]
    prefixes = [plain_hash(text[:p], fingerprints.BASES[0]) for p in places]
    whole_ = [plain_hash(text, b) for b in fingerprints.BASES]
    return base64.b64encode(np.array([n], "<i8").tobytes() + np.array(whole_, "<u4").tobytes() + np.array(registers, "<u2").tobytes() + np.array(prefixes, "<u4").tobytes()).decode()


def body(t):
    return t or ""


def brute_successive(rows):
    distinct = sorted({(-(i if i is not None else -(2**63)), hashlib.md5(body(t).encode()).hexdigest(), i, body(t)) for i, t in rows}, key=lambda x: x[:2])
    after = {k[2:]: distinct[(j + 1) % len(distinct)][3] for j, k in enumerate(distinct)}
    out = []
    for i, t in rows:
        t = body(t)
        nxt, tail = after[i, t], len(t) // 2
        edited = t[: len(t) - tail] + nxt[:tail]
        common = lambda a, b: len(os.path.commonprefix([a, b]))
        out.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited), common(t, edited), common(t, nxt)))
    return sorted(out)


def short_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000]


def shown(df):
    return sorted((repr(r[0]), *r[1:5], r["shared_edited"], r["shared_next"]) for r in df.collect())


def test_successive(spark, docs, monkeypatch):
    rows = short_rows(docs) + [(40, "same")] * 300 + [(41, "next")]  # a key with most of the rows
    given = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, md5 string").repartition(5)
    out = fingerprints.successive(given).cache()
    assert shown(out) == brute_successive(rows)
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    for a in ("", "abc", "x" * 64, "y" * 65, "z" * 128, "ab" * 300):
        assert fingerprints.fingerprint(fingerprints.PrefixHashes(a)) == plain_print(a)
    for r in out.collect():
        assert r["near_edited"] == fingerprints.alike(r["fingerprint"], r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])


def test_successive_of_few(spark, no_docs):
    assert fingerprints.successive(no_docs).collect() == []
    for rows in ([(1, "only one")], [(1, "twice")] * 2, [(None, None)], [(1, "ab"), (2, "cd")]):
        assert shown(fingerprints.successive(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_successive(rows)


def test_likeness_ranks():
    rng = np.random.default_rng(2)
    words_ = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(500)]
    text = lambda: " ".join(rng.choice(words_, 400))
    for _ in range(20):
        a, b = text(), text()
        mark = lambda t: fingerprints.fingerprint(fingerprints.PrefixHashes(t))
        near = a[:1000] + "changed" + a[1010:]
        half = a[: len(a) // 2] + b[: len(a) // 2]
        assert 1 > fingerprints.alike(mark(a), mark(near)) > fingerprints.alike(mark(a), mark(half)) > 0.3 > 0.25 > fingerprints.alike(mark(a), mark(b))


def test_spans_and_extensions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 50)
    rng = np.random.default_rng(3)
    a = "".join(rng.choice(list("abc"), 700))
    b = "".join(rng.choice(list("abc"), 90)) + a[200:520] + "é" + a[521:]
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for i, j in rng.integers(0, len(b), (300, 2)).tolist() + [[200, 90], [250, 140], [521, 411], [700, 0], [0, len(b)]]:
        naive = 0
        while i + naive < len(a) and j + naive < len(b) and a[i + naive] == b[j + naive]:
            naive += 1
        assert x.common(i, y, j) == naive
        assert x.equal(i, y, j, naive) and not x.equal(i, y, j, naive + 1)
    df = spark.createDataFrame([(a, 200, b, 90), (None, 5, "x", 0)], "a string, i int, b string, j int")
    assert [r[0] for r in df.select(fingerprints.common_extension("a", "i", "b", "j")).collect()] == [320, 0]
    marks = fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, None), (2, a)], "doc_id long, text string"))
    assert [r[0] for r in marks.where("n_chars > 0").select(fingerprints.likeness("fingerprint", "fingerprint")).collect()] == [1.0, 1.0]
