"""Nearest neighbours and packing."""

import numpy as np
import pytest

from pairstrand.llm import ann, packing

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, part string"


def brute(ids, x, q_id, q, k):
    scores = (x * q).sum(1)
    own = ids != q_id
    order = np.lexsort((ids[own], -scores[own]))[:k]
    return list(zip(ids[own][order].tolist(), scores[own][order].tolist(), strict=True))


def vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in row], 0, "i", "v", "p") for i, row in enumerate(x)] + [(i, e, 0, "i", "v", "p") for i, e in more]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = vectors(spark, x)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    ids, found = np.arange(3000), {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        want = brute(ids, x.astype(float), q, x[q].astype(float), 20)
        hit += len({w[0] for w in want} & {r[1] for r in rows})
        exact = {i: s for i, s in brute(ids, x.astype(float), q, x[q].astype(float), 3000)}
        assert all(s == exact[i] for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    assert len(found) == 150 and hit / (150 * 20) >= 0.9


def test_small_tables_are_exact_and_odd_vectors_stay_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[30:] = x[0]  # half of all rows are equal
    odd = [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan"), 0.0, 0.0, 1.0]), (105, [float("inf"), 0.0, 0.0, 1.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    df = vectors(spark, x, odd)
    df = df.union(df.where("vec_id = 0"))  # a repeated row counts once
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40}
    for q, rows in got.items():
        assert [(i, s) for _, i, s in sorted(rows)] == brute(np.arange(60), x.astype(float), q, x[q].astype(float), 20)
    few = vectors(spark, x[:5])
    assert ann.nearest(few, few.where("vec_id % 20 = 0")).count() == 4
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0
    assert ann.nearest(vectors(spark, x[:0], odd[:1]), few).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(125 * (1 + ann.SLACK))


def check(rows, lengths, capacities):
    """Every token has one place, and no bin is over its (permitted) size."""
    bins = {}
    got = {}
    for r in rows:
        assert 0 < r["length"] <= max(capacities) and r["capacity"] in capacities
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    assert {i: sorted(p) for i, p in got.items()} == {i: [(s, min(max(capacities), n - s)) for s in range(0, n, max(capacities))] for i, n in lengths.items() if n}
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), places in bins.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and capacity == min(c for c in capacities if c >= at)


@pytest.mark.parametrize("capacities", [(8,), (4, 8, 16), (512, 1024, 2048, 4096)])
def test_pack(spark, capacities):
    rng = np.random.default_rng(4)
    lengths = {i: int(n) for i, n in enumerate(rng.integers(0, 3 * max(capacities), 400))} | {i: max(capacities) // 2 for i in range(1000, 1300)}
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in lengths.items()], "doc_id long, n_tokens long, piece string, bin_id int").repartition(3)
    rows = packing.pack(df, capacities).collect()
    check(rows, lengths, capacities)
    used = sum(r["length"] for r in rows)
    total = sum({r["bin_id"]: r["capacity"] for r in rows}.values())
    assert used / total > 0.85


def test_pack_odd(spark):
    df = spark.createDataFrame([(None, 5), (1, None), (2, 0), (3, 7), (3, 7)], "doc_id long, n_tokens long")
    rows = packing.pack(df, (8,)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 5), (3, 7), (3, 7)]
    assert packing.pack(df.limit(0), (8,)).count() == 0


def test_plan_costs_no_more_than_one_size():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 700, 3000), return_counts=True), strict=True)}
    several = sum(p.capacity * p.copies for p in packing.plan(histogram, (256, 512, 1024)))
    single = sum(p.capacity * p.copies for p in packing.plan(histogram, (1024,)))
    assert several <= single
    assert sum(len(p.lengths) * p.copies for p in packing.plan(histogram, (256, 512, 1024))) == sum(histogram.values())
    with pytest.raises(ValueError, match="no sequence"):
        packing.plan({2000: 1}, (1024,))
