"""The registered queries on the smallest tables, against brute force."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairstrand.llm import packing, queries
from pairstrand.llm.settings import END_ID, VOCABULARY

from test_ann_packing import brute, check
from test_texts import body, brute_components, brute_removals, shingle_set

SMALL, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: body(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    return {i: (library.encode(t, add_special_tokens=False).ids, library) for i, t in texts.items()}


def test_op2(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and np.isfinite(np.array(r["embedding"], float)).all() and any(r["embedding"])]
    x, names = np.array([v for _, v in good], float), np.array([i for i, _ in good])
    got = {}
    for r in queries.op2_ann(spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    for k, i in enumerate(names.tolist()):
        if i % 20 == 0:
            want = brute(names, x, i, x[k], 20)
            hit, n = hit + len({w[0] for w in want} & {v for _, v, _ in got[i]}), n + len(want)
    assert set(got) == {i for i in names.tolist() if i % 20 == 0} and hit / n >= 0.9


def test_op3(spark, texts):
    sets = {i: [shingle_set(t)] for i, t in texts.items()}
    want = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op3_near_dedup(spark, SMALL).collect()}
    assert got == {i: (len(sets[i][0]), c, c == i) for i, c in want.items()}


def test_op4_op6_op7(spark, texts, ids):
    got = {tuple(r) for r in queries.op4_bpe(spark, SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(lib.decode(x, skip_special_tokens=False).encode())) for i, (x, lib) in ids.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op6_token_counts(spark, SMALL).collect()}
    assert counts == {i: len(x) + 1 for i, (x, _) in ids.items()}
    want, start = set(), 0
    for i, (x, _) in sorted(ids.items()):
        want.add((i, start, len(x) + 1, zlib.crc32(np.array([*x, END_ID], "<u4").tobytes())))
        start += len(x) + 1
    assert {tuple(r) for r in queries.op7_token_files(spark, SMALL).collect()} == want


def test_op5(spark, ids):
    check(queries.op5_packing(spark, SMALL).collect(), {i: len(x) + 1 for i, (x, _) in ids.items()}, packing.CAPACITIES)


def test_op8(spark):
    """Held-out labels of the tables are told apart, and the score never sees them."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, LABELLED).collect()
    assert len(rows) == spark.read.parquet(f"{LABELLED}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.95


def test_op10(spark, texts):
    order = sorted(texts)
    want = Counter(zip(order, brute_removals([texts[i].encode() for i in order], 400), strict=True))
    got = queries.op10_suffix_dedup(spark, SMALL).collect()
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want


def best_fit(lengths, capacities):
    """Item by item, longest first, into the fullest bin that has room; new bins have the largest size and are downsized at last."""
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(max(capacities) - used, k) for k, used in enumerate(bins) if max(capacities) - used >= n]
        if room:
            bins[min(room)[1]] += n
        else:
            bins.append(n)
    return sum(min(c for c in capacities if c >= used) + packing.BIN_COST for used in bins)


@pytest.mark.parametrize("capacities", [(1000,), (256, 512, 1024), (512, 1024, 2048, 4096)])
def test_plan_against_best_fit(capacities):
    rng, most = np.random.default_rng(1), max(capacities)
    for lengths in (rng.integers(1, most + 1, 300), np.minimum(most, rng.lognormal(5.5, 1, 300).astype(int) + 1), rng.integers(1, most // 4, 300), rng.integers(most // 3, most // 2 + 40, 300)):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        cost = sum((p.capacity + packing.BIN_COST) * p.copies for p in packing.plan(histogram, capacities))
        plain = best_fit(lengths.tolist(), capacities)
        assert cost == plain if len(capacities) == 1 else cost <= 1.01 * plain
